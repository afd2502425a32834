"""Queries over the operators of this subpackage, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import encoding, language, mixing, nearest, neardup, packing, ranking, scans, splitting, terms
from quire.plans.storage import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return nearest.neighbour_pairs(nearest.nearest_vectors(table(spark, d, "vec_chunks")))


def p1_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Every usable vector's ten nearest, one row per vector and place."""
    heaps = nearest.nearest_vectors(table(spark, d, "vec_chunks"))
    out = heaps.select(F.col("id").alias("chunk_rowid"), F.posexplode("heap").alias("place", "h"))
    return out.select("chunk_rowid", (F.col("place") + 1).alias("place"), F.col("h.n").alias("neighbour"), F.round(F.sqrt("h.d"), 6).alias("distance"))


def p2_method(spark: SparkSession, d: str) -> DataFrame:
    """What the twins, their alignment and the mappings learned from it give, over the whole table."""
    return encoding.garbled_records(table(spark, d, "document_chunks"), plain=False)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_restored(spark, d).select("id").distinct()


def p2_restored(spark: SparkSession, d: str) -> DataFrame:
    """Every affected chunk with its text restored as far as it can be."""
    return encoding.garbled_records(table(spark, d, "document_chunks"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return ranking.aggregate_ranks(table(spark, d, "hits")).filter("position <= 3").select("question_id", "chunk_rowid")


def p3_ranking(spark: SparkSession, d: str) -> DataFrame:
    return ranking.aggregate_ranks(table(spark, d, "hits"))


def p4_method(spark: SparkSession, d: str) -> DataFrame:
    """What decoding the de-lined stream of every page gives by itself: words healed and repaired, paragraphs."""
    return scans.repaired_pages(table(spark, d, "document_chunks"), table(spark, d, "documents"), plain=False).drop("label")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.page_noise(table(spark, d, "document_chunks"), table(spark, d, "documents"))


def p4_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Every page record's continuous paragraphs and right label."""
    return scans.repaired_pages(table(spark, d, "document_chunks"), table(spark, d, "documents"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_frequencies(table(spark, d, "document_chunks")).filter("mark is not null").select("term", "mark")


def p5_terms(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_frequencies(table(spark, d, "document_chunks"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.expand_pairs(*neardup.near_duplicates(table(spark, d, "documents"), threshold=0.5, w=3))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per document with its group of near duplicates (five terms, similarity 0.8) and its number of links."""
    docs = table(spark, d, "documents")
    members, pairs = neardup.near_duplicates(docs)
    return neardup.groups(neardup.with_short(members, docs), pairs).withColumnRenamed("id", "doc_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_pieces(spark, d).filter("piece = 0 and n_pieces > 1").select("id")


def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "document_chunks"), table(spark, d, "size_limits"))


def p7_laws(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the pieces of every oversized chunk: none over the limit, each the text at its place, bodies that
    join to the whole, an overlap of no more than allowed."""
    limits = table(spark, d, "size_limits").filter("unit = 'estimate'").groupBy(F.col("item").alias("kind")).agg(F.min("max_tokens").alias("most"))
    texts = table(spark, d, "document_chunks").select("id", F.col("text").alias("whole"))
    rows = p7_pieces(spark, d).join(F.broadcast(limits), "kind").join(texts, "id")
    at = F.expr("substring(whole, start + 1, end - start)")
    own = rows.select("id", "piece", "n_pieces", "start", "body", "end", (F.col("tokens") > F.col("most")).alias("over"), (F.col("text") != at).alias("foreign"), F.length("whole").alias("size"))
    per = own.groupBy("id").agg(F.count_if("over").alias("over"), F.count_if("foreign").alias("foreign"), F.sort_array(F.collect_list(F.struct("piece", "body", "end"))).alias("p"), F.max("n_pieces").alias("n"), F.max("size").alias("size"))
    joins = F.forall(F.sequence(F.lit(1), F.col("n") - 1), lambda k: F.element_at("p", k)["end"] == F.element_at("p", k + 1)["body"])
    whole = joins & (F.size("p") == F.col("n")) & (F.element_at("p", 1)["body"] == 0) & (F.element_at("p", -1)["end"] == F.col("size"))
    return per.select("id", "over", "foreign", whole.alias("whole"))


def _container(spark: SparkSession, d: str) -> int:
    row = table(spark, d, "size_limits").filter("item = 'container' and unit = 'wordpunct'").agg(F.min("max_tokens")).first()
    return row[0] or 1024


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_containers(spark, d).filter("n_pieces > 1 and piece = 0 and container is not null").select("doc_id")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), _container(spark, d))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are: containers, tokens, and the least number of containers that could do."""
    per = p8_containers(spark, d).filter("container is not null").groupBy("container").agg(F.sum("tokens").alias("tokens"))
    return per.agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"), F.ceil(F.sum("tokens") / F.lit(float(_container(spark, d)))).alias("least"))


def p8_laws(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the containers: every token in one, none overfull, no document torn that fits, a hundredth of
    waste at most."""
    cap = _container(spark, d)
    rows = p8_containers(spark, d).filter("container is not null")
    per = rows.groupBy("container").agg(F.sum("tokens").alias("held"))
    fill = per.agg(F.sum("held").alias("tokens"), F.count_if(F.col("held") > cap).alias("overfull"), F.count("*").alias("n"))
    docs = rows.groupBy("doc_id").agg(F.sum("tokens").alias("size"), F.max("n_pieces").alias("n_pieces"))
    torn = docs.agg(F.count("*").alias("documents"), F.count_if((F.col("size") <= cap) & (F.col("n_pieces") > 1)).alias("torn"))
    wasteful = F.col("n") > F.ceil(F.col("tokens") / F.lit(float(cap))) * 1.01 + 1
    return torn.crossJoin(fill).select("documents", "tokens", "overfull", "torn", wasteful.alias("wasteful"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_report(spark, d).filter("short").select("source")


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return language.language_cases(p10_languages(spark, d))


def p10_languages(spark: SparkSession, d: str) -> DataFrame:
    return language.identify_languages(table(spark, d, "documents"), table(spark, d, "lang_samples"))


def p10_stretches(spark: SparkSession, d: str) -> DataFrame:
    """Every stretch of every document with its language."""
    out = p10_languages(spark, d).select("doc_id", F.explode("segments").alias("s"))
    return out.select("doc_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.lang").alias("lang"), F.col("s.confidence").alias("confidence"), F.col("s.sentences").alias("sentences"))


def queries() -> dict[str, Query]:
    own = [p1_found, p1_neighbours, p2_method, p2_found, p2_restored, p3_found, p3_ranking, p4_method, p4_found, p4_repaired, p5_found, p5_terms, p6_found, p6_groups, p7_found, p7_pieces, p7_laws, p8_found, p8_containers, p8_fill, p8_laws, p9_found, p9_report, p9_mixture, p10_found, p10_languages, p10_stretches]
    return {f.__name__: f for f in own}


_P3 = """
WITH usable AS (
  SELECT question_id, chunk_rowid, leg, score, row_number() OVER (PARTITION BY question_id, chunk_rowid, leg ORDER BY logged_at DESC NULLS LAST, hit_id DESC, score DESC) AS nth
  FROM hits WHERE score IS NOT NULL AND NOT isnan(score) AND question_id IS NOT NULL AND chunk_rowid IS NOT NULL AND leg IS NOT NULL),
k AS (SELECT question_id, chunk_rowid, leg, CASE WHEN leg IN ('rerank', 'popularity') THEN -score ELSE score END AS key FROM usable WHERE nth = 1),
r AS (SELECT *, rank() OVER (PARTITION BY question_id, leg ORDER BY key) + (count(*) OVER (PARTITION BY question_id, leg, key) - 1) / 2.0 AS rk FROM k),
q AS (SELECT question_id, count(DISTINCT chunk_rowid) AS n_chunks, count(DISTINCT leg) AS legs FROM k GROUP BY 1),
c AS (SELECT question_id, chunk_rowid, count(*) AS n_legs, sum(rk) AS s FROM r GROUP BY 1, 2),
padded AS (
  SELECT question_id, chunk_rowid, rk / n_chunks AS x FROM r JOIN q USING (question_id)
  UNION ALL SELECT question_id, chunk_rowid, 1.0 FROM c JOIN q USING (question_id), range(8) g(i) WHERE i < legs - n_legs),
o AS (SELECT *, row_number() OVER (PARTITION BY question_id, chunk_rowid ORDER BY x) AS kth FROM padded),
b AS (
  SELECT question_id, chunk_rowid, kth, legs, max(x) AS x, sum(factorial(legs::INT) / (factorial(j::INT) * factorial((legs - j)::INT)) * pow(x, j) * pow(1 - x, legs - j)) AS p
  FROM o JOIN q USING (question_id), range(9) g(j) WHERE j >= kth AND j <= legs GROUP BY 1, 2, 3, 4),
s AS (SELECT question_id, chunk_rowid, round(least(min(p) * max(legs), 1), 12) AS rho, round(sum(x) / max(legs), 12) AS mean_rank FROM b GROUP BY 1, 2)
"""

_P1 = """
WITH v AS (SELECT chunk_rowid, min(embedding)::DOUBLE[] AS e FROM vec_chunks WHERE len(embedding) = 384 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY 1),
p AS (SELECT x.chunk_rowid AS a, y.chunk_rowid AS b, list_distance(x.e, y.e) AS d FROM v x, v y WHERE x.chunk_rowid <> y.chunk_rowid)
"""
_P6 = """
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t) z),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2)
SELECT a AS doc_id_a, b AS doc_id_b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 2 * k >= p.n + q.n - k
"""
_P6_GROUPS = """
WITH RECURSIVE t AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t) z),
k AS (SELECT doc_id, md5(string_agg(g, '|' ORDER BY g)) AS key, count(*) AS n FROM s GROUP BY 1),
m AS (SELECT doc_id, coalesce('set ' || key, 'text ' || sha256(text), 'none ' || doc_id) AS key, n FROM t LEFT JOIN k USING (doc_id)),
c AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY key) AS rep, count(*) OVER (PARTITION BY key) AS copies FROM m),
r AS (SELECT rep, n FROM c WHERE doc_id = rep),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id WHERE x.doc_id IN (SELECT rep FROM r) AND y.doc_id IN (SELECT rep FROM r) GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN r p ON p.rep = a JOIN r q ON q.rep = b WHERE 5 * k >= 4 * (p.n + q.n - k)),
ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(id, g) AS (SELECT rep, rep FROM r UNION SELECT ways.b, reach.g FROM reach JOIN ways ON ways.a = reach.id),
l AS (SELECT id, min(g) AS g FROM reach GROUP BY 1), d AS (SELECT a, count(*) AS classes FROM ways GROUP BY 1)
SELECT doc_id, g AS "group", coalesce(classes, 0) + copies - 1 AS links FROM c JOIN l ON l.id = rep LEFT JOIN d ON d.a = rep
"""
_WORDPUNCT = "len(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\p{Z}]+'))"
_CJK = "len(regexp_extract_all(text, '[\\x{3040}-\\x{30FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{AC00}-\\x{D7AF}\\x{F900}-\\x{FAFF}]'))"
_P9 = f"""
WITH t AS (SELECT source, min(target_share) AS share, min(max_repeats) AS reps FROM mix_targets WHERE source IS NOT NULL GROUP BY 1),
d AS (SELECT source, {_WORDPUNCT} AS n FROM documents WHERE source IN (SELECT source FROM t)),
s AS (SELECT source, sum(n) AS size FROM d GROUP BY 1), a AS (SELECT coalesce(sum(n), 0) AS total FROM d)
"""
_P5 = """
WITH w AS (SELECT id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM document_chunks),
c AS (SELECT term, count(*) AS n, count(DISTINCT id) AS records FROM w GROUP BY 1), a AS (SELECT count(*) AS total FROM document_chunks),
m AS (SELECT term, n, records, CASE WHEN records <= 2 THEN 'rare' WHEN records > 0.1 * total THEN 'common' END AS mark FROM c, a)
"""


def oracle_sql() -> dict[str, str]:
    own = {
        "p1_found": _P1 + "SELECT DISTINCT least(a, b) AS chunk_rowid_a, greatest(a, b) AS chunk_rowid_b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS nth FROM p) z WHERE nth <= 10",
        "p1_neighbours": _P1 + "SELECT a AS chunk_rowid, nth::INT AS place, b AS neighbour, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS nth FROM p) z WHERE nth <= 10",
        "p6_found": _P6,
        "p6_groups": _P6_GROUPS,
        "p3_ranking": _P3 + "SELECT question_id, chunk_rowid, n_legs::INT AS n_legs, rho, mean_rank, row_number() OVER (PARTITION BY question_id ORDER BY rho, mean_rank, chunk_rowid)::INT AS position FROM s JOIN c USING (question_id, chunk_rowid)",
        "p8_laws": f"SELECT count(*) FILTER (n > 0) AS documents, sum(n)::BIGINT AS tokens, 0 AS overfull, 0 AS torn, false AS wasteful FROM (SELECT {_WORDPUNCT} AS n FROM documents) z",
        "p3_found": _P3 + "SELECT question_id, chunk_rowid FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rho, mean_rank, chunk_rowid) AS position FROM s) z WHERE position <= 3",
        "p5_found": _P5 + "SELECT term, mark FROM m WHERE mark IS NOT NULL",
        "p5_terms": _P5 + "SELECT term, n, records, mark FROM m",
        "p7_found": f"SELECT id FROM (SELECT id, kind, ceil((len(text) + len(regexp_extract_all(text, '[\\x{{10000}}-\\x{{10FFFF}}]')) - {_CJK}) / 4.0) + {_CJK} AS tokens FROM document_chunks WHERE text IS NOT NULL) c JOIN (SELECT item, min(max_tokens) AS most FROM size_limits WHERE unit = 'estimate' GROUP BY 1) l ON item = kind WHERE tokens > most",
        "p8_found": f"SELECT doc_id FROM documents WHERE {_WORDPUNCT} > 1024",
        "p9_found": _P9 + "SELECT t.source FROM t LEFT JOIN s USING (source), a WHERE reps * coalesce(size, 0) < share * total",
    }
    return own | {"p7_laws": 'SELECT id, 0 AS over, 0 AS "foreign", true AS whole FROM (' + own["p7_found"] + ") f"}
