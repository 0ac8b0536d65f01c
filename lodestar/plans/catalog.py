"""Registered queries of the attribution engine over whole tables, and the SQL that gives the same rows.

benchmark items and the assistant's turns of conversations are answers; documents are one shared corpus of sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .. import api
from ..config import CitationConfig
from ..functions.cutting import token_digests
from ..functions.segments import with_sentences
from ..operators import citations as C
from ..operators.lexical import Sources, frequencies
from ..operators.passages import exploded, passages_of, with_tokens
from ..operators.vectors import cosine_top, index_norms
from ..sources import adapters


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.documents(table(spark, sf_dir, "documents"), source_id="doc_id", position="doc_id")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.lit("all").alias("corpus_id"), F.col("text").alias("answer"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return t.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"), F.lit("all").alias("corpus_id"), F.col("text").alias("answer"))


def source_documents(spark, sf_dir):
    return sources(spark, sf_dir).select("source_pos", "source_id", "source_index", "base_doc_offset", F.element_at("metadata", "lang").alias("lang"), F.length("text").alias("n"))


def source_chunks(spark, sf_dir):
    """Every document after its first 100 characters, as a chunk of the whole."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("whole"), F.substring("text", 101, 1 << 30).alias("text"), F.lit(100).alias("start_index"))
    got = adapters.chunks(rows, source_id="doc_id", full_text="whole", position="doc_id")
    ends = rows.select(F.col("doc_id").alias("source_pos"), adapters.chunk_ends(rows).alias("chunk_end"))
    return got.join(ends, "source_pos").select("source_pos", "source_id", "base_doc_offset", "chunk_end", F.length("text").alias("n"), F.length("full_text").alias("n_full"))


def segment_sources(spark, sf_dir):
    rows = with_sentences(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return exploded(rows.select("doc_id", "segments"), "segments", "s", "sentence_no").select("doc_id", "sentence_no", F.col("s.text").alias("text"), F.col("s.start").alias("char_start"), F.col("s.end").alias("char_end"))


def segment_answers(spark, sf_dir):
    return api.spans_of(turns(spark, sf_dir)).select("query_id", "span_no", "paragraph_index", "text", "char_start", "char_end")


def passage_windows(spark, sf_dir):
    got = passages_of(sources(spark, sf_dir), 3, 2)
    return got.select("source_pos", "passage_no", "segment_start", "segment_end", "doc_char_start", "doc_char_end", F.md5("text").alias("digest"))


def tokenize(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rows.mapInArrow(token_digests(), T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL("n_tokens int, digest string").fields]))


def token_idf(spark, sf_dir):
    return frequencies(sources(spark, sf_dir)).select("token", "df", F.round("idf", 9).alias("idf"))


def lexical_topn(spark, sf_dir):
    best = Sources(api.prepare_spans(items(spark, sf_dir)), sources(spark, sf_dir), 20).top
    return best.select("query_id", "span_no", "candidate_index", "rank", F.round("lexical_score", 9).alias("lexical_score"))


def cosine_topk(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.lit("all").alias("corpus_id"), "vec_id", "embedding")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), "corpus_id", "embedding")
    return cosine_top(q, v, 10).select("query", "vec_id", "rank", F.round("cosine", 6).alias("cosine"))


def embedding_norms(spark, sf_dir):
    return index_norms(table(spark, sf_dir, "embeddings")).select("vec_id", F.round("norm", 6).alias("norm"))


def _aligned_items(spark, sf_dir) -> DataFrame:
    """Every item, whole, aligned with its 50 best passages."""
    answers = items(spark, sf_dir).withColumn("span_no", F.lit(0)).withColumnRenamed("answer", "text")
    spans = with_tokens(answers, "text", lambda r: r)
    of = Sources(spans, sources(spark, sf_dir), 50)
    pairs = of.top.join(of.texts.select("corpus_id", "candidate_index", F.col("text").alias("passage_text")), ["corpus_id", "candidate_index"]).join(answers.select("query_id", F.col("text").alias("span_text")), "query_id")
    pairs = pairs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "corpus_id", "candidate_index")
    return C.aligned(pairs, CitationConfig())


ALIGNED = ["query_id", "candidate_index", "score", "token_start", "token_end", "query_start", "query_end", "matches"]


def align_pairs(spark, sf_dir):
    return _aligned_items(spark, sf_dir).select(*ALIGNED)


def align_topk(spark, sf_dir, k: int = 5):
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "token_start", F.desc(F.col("token_end") - F.col("token_start")), "query_start", "candidate_index", "token_end", "query_end")
    return _aligned_items(spark, sf_dir).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select(*ALIGNED, "place")


def align_best(spark, sf_dir):
    return align_topk(spark, sf_dir, 1)


def _cited(spark, sf_dir, cfg: CitationConfig | None = None) -> DataFrame:
    return api.align_citations(items(spark, sf_dir), sources(spark, sf_dir), cfg)


FLAT = ["query_id", "span_no", "status", "rank", "round(score, 9) AS score", "source_id", "source_index", "candidate_index", "char_start", "char_end", "evidence"]


def citations(spark, sf_dir):
    return api.citations_of(_cited(spark, sf_dir)).selectExpr(*FLAT)


def citations_strict(spark, sf_dir):
    return api.citations_of(_cited(spark, sf_dir, CitationConfig.strict())).selectExpr(*FLAT)


def citations_multispan(spark, sf_dir):
    found = api.citations_of(_cited(spark, sf_dir, CitationConfig(multi_span_evidence=True, window_size_sentences=2)))
    return found.selectExpr(*FLAT, "size(evidence_spans) AS n_spans")


def status_counts(spark, sf_dir):
    return _cited(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


def _rounded(found: DataFrame) -> DataFrame:
    return found.select(*[F.round(c, 9).alias(c) if kind == "double" else F.col(c) for c, kind in found.dtypes])


def groundedness(spark, sf_dir):
    return _rounded(api.check_groundedness(items(spark, sf_dir), sources(spark, sf_dir)).drop("span_confidences", "unsupported_spans", "weakly_supported_spans"))


def groundedness_of_turns(spark, sf_dir):
    return _rounded(api.check_groundedness(turns(spark, sf_dir), sources(spark, sf_dir)).drop("span_confidences", "unsupported_spans", "weakly_supported_spans"))


def is_grounded(spark, sf_dir):
    return api.is_grounded(items(spark, sf_dir), sources(spark, sf_dir))


def is_hallucinated(spark, sf_dir):
    return api.is_hallucinated(items(spark, sf_dir), sources(spark, sf_dir))


def verify_facts(spark, sf_dir):
    return _rounded(api.verify_facts(items(spark, sf_dir), sources(spark, sf_dir)).drop("verified_claims", "unverified_claims", "partial_claims"))


def annotate_answer(spark, sf_dir):
    return api.annotate_answer(items(spark, sf_dir), sources(spark, sf_dir))


def citation_summary(spark, sf_dir):
    answers = items(spark, sf_dir)
    return api.get_citation_summary(api.align_citations(answers, sources(spark, sf_dir)), answers)


QUERIES = {f.__name__: f for f in (source_documents, source_chunks, segment_sources, segment_answers, passage_windows, tokenize, token_idf, lexical_topn, cosine_topk, embedding_norms, align_pairs, align_topk, align_best, citations, citations_strict, citations_multispan, status_counts, groundedness, groundedness_of_turns, is_grounded, is_hallucinated, verify_facts, annotate_answer, citation_summary)}

_SPACE = r"[\s\x0b\x1c-\x1f]"


def _sentences_sql(rows: str, key: str, newlines: bool, pre: str = "") -> str:
    """CTEs that cut t of `rows` (key columns, t, base) into the table `{pre}sentences` (key, no, text, a, b)."""
    marked = rf"regexp_replace(regexp_replace(t, '([.?!])({_SPACE})', '\1' || chr(1) || '\2', 'g'), ';', ';' || chr(1), 'g')"
    # a mark between two ends of sentences needs a second pass only where ends touch white space, which never overlap
    if newlines:
        marked = rf"regexp_replace({marked}, '\n', chr(10) || chr(1), 'g')"
    return f"""
{pre}cut AS (SELECT {key}, base, string_split({marked}, chr(1)) AS p FROM {rows}),
{pre}each AS (SELECT {key}, base, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM {pre}cut),
{pre}placed AS (SELECT {key}, x, i, base + coalesce(sum(length(x)) OVER (PARTITION BY {key} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM {pre}each),
{pre}trim1 AS (SELECT {key}, i, s + length(x) - length(regexp_replace(x, '^{_SPACE}+', '')) AS a, regexp_replace(regexp_replace(x, '^{_SPACE}+', ''), '{_SPACE}+$', '') AS text FROM {pre}placed),
{pre}sentences AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY i) - 1 AS no, text, a, a + length(text) AS b FROM {pre}trim1 WHERE text <> '')"""


_DOC_SENTENCES = "docs AS (SELECT doc_id, coalesce(text, '') AS t, 0 AS base FROM documents)," + _sentences_sql("docs", "doc_id", True)
_TOKEN = "'([0-9]+(?:[.,][0-9]+)*|[%$€£]|[A-Za-z0-9À-ÖØ-Þà-öø-ÿß]+(?:[''’\\-][A-Za-z0-9À-ÖØ-Þà-öø-ÿß]+)*)'"


def _tokens_sql(column: str) -> str:
    x = "replace(replace(lower(x), '’', ''''), 'ß', 'ss')"
    return f"list_transform(regexp_extract_all({column}, {_TOKEN}, 1), lambda x: CASE {x} WHEN '%' THEN 'percent' WHEN '$' THEN 'dollar' WHEN '€' THEN 'euro' WHEN '£' THEN 'pound' ELSE CASE WHEN regexp_matches(x, '^[0-9]') THEN replace({x}, ',', '') ELSE {x} END END)"


_IDF = f"""
passages AS MATERIALIZED (SELECT doc_id, no, text, a, b, row_number() OVER (ORDER BY doc_id, no) - 1 AS cand, {_tokens_sql("text")} AS tokens FROM sentences),
df AS (SELECT token, count(*) AS df FROM (SELECT DISTINCT doc_id, no, unnest(tokens) AS token FROM passages) GROUP BY token),
idf AS (SELECT token, df, ln(((SELECT count(*) FROM passages) + 1) / (df + 1)) + 1 AS idf FROM df)"""

_PARAGRAPHS = r"""
pcut AS (SELECT query_id, string_split(regexp_replace(whole, '(\n[ \t]*\n+)', '\1' || chr(2), 'g'), chr(2)) AS p FROM answers),
peach AS (SELECT query_id, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM pcut),
pplaced AS (SELECT query_id, x, i, coalesce(sum(length(x)) OVER (PARTITION BY query_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM peach),
ptrim AS (SELECT query_id, i, s + length(x) - length(regexp_replace(x, '^[\s\x0b\x1c-\x1f]+', '')) AS base, regexp_replace(regexp_replace(x, '^[\s\x0b\x1c-\x1f]+', ''), '[\s\x0b\x1c-\x1f]+$', '') AS t FROM pplaced),
paras AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY i) - 1)::INTEGER AS paragraph_index, base, t FROM ptrim WHERE t <> ''),"""

_TURNS = "answers AS (SELECT concat(conv_id, '/', turn) AS query_id, coalesce(text, '') AS whole FROM conversations WHERE role = 'assistant'),"
_ITEMS = "answers AS (SELECT item_id AS query_id, coalesce(text, '') AS whole FROM benchmark),"

_SPANS = _ITEMS + _PARAGRAPHS + _sentences_sql("paras", "query_id, paragraph_index", False, "s") + f""",
spans AS MATERIALIZED (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY a) - 1 AS span_no, text, a, a + length(text) AS b, {_tokens_sql("text")} AS tokens FROM ssentences)"""
_WHOLE_ITEMS = f"spans AS MATERIALIZED (SELECT item_id AS query_id, 0 AS span_no, text, {_tokens_sql('text')} AS tokens FROM benchmark)"


def _retrieved_sql(spans: str, most: int) -> str:
    """CTEs up to `best`: the `most` best passages of each span by shared weight."""
    return f"""{_DOC_SENTENCES}, {_IDF}, {spans},
weighted AS (SELECT query_id, span_no, token, round(coalesce(idf, 1.0) * 1000000000000)::BIGINT AS w FROM (SELECT DISTINCT query_id, span_no, unnest(tokens) AS token FROM spans) LEFT JOIN idf USING (token)),
totals AS (SELECT query_id, span_no, sum(w)::DOUBLE AS total FROM weighted GROUP BY ALL),
shared AS (SELECT query_id, span_no, cand, doc_id, sum(w)::DOUBLE AS part FROM weighted JOIN (SELECT DISTINCT cand, doc_id, unnest(tokens) AS token FROM passages) USING (token) GROUP BY ALL),
best AS MATERIALIZED (SELECT query_id, span_no, cand, doc_id, part / total AS lexical, row_number() OVER (PARTITION BY query_id, span_no ORDER BY part / total DESC, doc_id, cand) AS rank
  FROM shared JOIN totals USING (query_id, span_no) QUALIFY rank <= {most})"""


def _aligned_sql(least: float = 0.0) -> str:
    """CTEs up to `aligned`: the alignments of best pairs, by anti-diagonals of the score matrix. Each cell keeps where its
    path began and its matches; a step back prefers the diagonal, then the cell above. Pairs that cannot reach the least
    share of matched tokens are left out."""
    return f"""
pairs AS MATERIALIZED (SELECT row_number() OVER () AS pid, query_id, span_no, cand, list_transform(s.tokens, lambda x: hash(x)) AS q, list_transform(p.tokens, lambda x: hash(x)) AS k
  FROM best JOIN spans s USING (query_id, span_no) JOIN passages p USING (cand)
  WHERE len(list_filter(s.tokens, lambda x: list_contains(p.tokens, x))) >= {least} * len(s.tokens)),
cells AS (
  SELECT pid, unnest(generate_series(1, len(q))) AS i, 0 AS d, 0 AS h, 0 AS si, 0 AS sj, 0 AS m, 0 AS uh, 0 AS ui, 0 AS uj, 0 AS um FROM pairs
  UNION ALL
  SELECT pid, i, d + 1,
         CASE WHEN j BETWEEN 1 AND n THEN greatest(0, uh + same, ah - 1, h - 1) ELSE 0 END AS h2,
         CASE WHEN h2 = uh + same THEN CASE WHEN uh > 0 THEN ui ELSE i - 1 END WHEN h2 = ah - 1 THEN ai ELSE si END,
         CASE WHEN h2 = uh + same THEN CASE WHEN uh > 0 THEN uj ELSE j - 1 END WHEN h2 = ah - 1 THEN aj ELSE sj END,
         CASE WHEN h2 = 0 THEN 0 WHEN h2 = uh + same THEN um + (same = 2)::INTEGER WHEN h2 = ah - 1 THEN am ELSE m END,
         ah, ai, aj, am
  FROM (SELECT c.*, d + 1 - i AS j, len(k) AS n, CASE WHEN q[i] = k[d + 1 - i] THEN 2 ELSE -1 END AS same,
               lag(h, 1, 0) OVER w AS ah, lag(si, 1, 0) OVER w AS ai, lag(sj, 1, 0) OVER w AS aj, lag(m, 1, 0) OVER w AS am
        FROM cells c JOIN pairs USING (pid) WHERE d < len(q) + len(k) WINDOW w AS (PARTITION BY pid ORDER BY i))),
tops AS (SELECT pid, h, sj, d - i AS ej, si, i AS ei, m FROM cells WHERE h > 0 QUALIFY row_number() OVER (PARTITION BY pid ORDER BY h DESC, sj, d - i - sj DESC, si, d - i, i) = 1),
aligned AS MATERIALIZED (SELECT query_id, span_no, cand AS candidate_index, coalesce(h, 0)::INTEGER AS score, coalesce(sj, 0)::INTEGER AS token_start, coalesce(ej, 0)::INTEGER AS token_end,
  coalesce(si, 0)::INTEGER AS query_start, coalesce(ei, 0)::INTEGER AS query_end, coalesce(m, 0)::INTEGER AS matches, len(q) AS n_query FROM pairs LEFT JOIN tops USING (pid))"""


_ALIGNED_ITEMS = f"WITH RECURSIVE {_retrieved_sql(_WHOLE_ITEMS, 50)}, {_aligned_sql()}"
_ALIGNED_COLUMNS = ", ".join(ALIGNED)
_PLACED = f"SELECT {_ALIGNED_COLUMNS}, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, token_start, token_end - token_start DESC, query_start, candidate_index, token_end, query_end)::INTEGER AS place FROM aligned"


def _cited_sql(cfg: CitationConfig = CitationConfig()) -> str:
    """CTEs up to `cited` (a row a citation) and `judged` (a row a span, with its status and the coverage of its best)."""
    w = cfg.weights
    order = "score DESC, doc_id, start, stop - start DESC, candidate_index"
    return f"""WITH RECURSIVE {_retrieved_sql(_SPANS, cfg.max_candidates_lexical)}, {_aligned_sql(cfg.min_answer_coverage)},
marked AS (SELECT cand, string_split(regexp_replace(text, {_TOKEN}, chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS x FROM passages WHERE cand IN (SELECT candidate_index FROM aligned)),
scored AS (SELECT l.query_id, l.span_no, candidate_index, p.doc_id, matches / n_query AS coverage, p.text, p.a,
    p.a + list_sum(list_transform(x[1 : token_start + 1], lambda y: length(replace(y, chr(2), '')))) AS start,
    p.a + list_sum(list_transform(x[1 : token_end], lambda y: length(replace(y, chr(2), '')))) + strpos(x[token_end + 1], chr(2)) - 1 AS stop,
    {w.alignment} * (l.score / greatest(1, {cfg.match_score} * n_query)) + {w.answer_coverage} * (matches / n_query) + {w.evidence_coverage} * (matches / greatest(1, token_end - token_start)) + {w.lexical} * best.lexical AS score
  FROM aligned l JOIN best ON best.query_id = l.query_id AND best.span_no = l.span_no AND best.cand = l.candidate_index JOIN passages p ON p.cand = l.candidate_index JOIN marked ON marked.cand = l.candidate_index
  WHERE l.score >= {cfg.min_alignment_score} AND token_start < token_end AND matches / n_query >= {cfg.min_answer_coverage}),
kept1 AS (SELECT * FROM scored WHERE score >= {cfg.min_final_score} QUALIFY row_number() OVER (PARTITION BY query_id, span_no, doc_id, start, stop ORDER BY {order}) = 1),
kept2 AS (SELECT * FROM kept1 QUALIFY row_number() OVER (PARTITION BY query_id, span_no, doc_id ORDER BY {order}) <= {cfg.max_citations_per_source}),
cited AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id, span_no ORDER BY {order}) AS rank FROM kept2 QUALIFY rank <= {cfg.top_k}),
judged AS MATERIALIZED (SELECT s.query_id, s.span_no, s.text, s.a, s.b, c.coverage, CASE WHEN c.coverage IS NULL THEN 'unsupported' WHEN c.coverage >= {cfg.supported_answer_coverage} THEN 'supported' ELSE 'partial' END AS status
  FROM spans s LEFT JOIN cited c ON c.query_id = s.query_id AND c.span_no = s.span_no AND c.rank = 1)"""


_FLAT_SQL = """SELECT c.query_id, c.span_no::INTEGER AS span_no, j.status, c.rank::INTEGER AS rank, round(c.score, 9) AS score, c.doc_id::VARCHAR AS source_id, c.doc_id AS source_index, c.candidate_index, c.start::INTEGER AS char_start, c.stop::INTEGER AS char_end,
  substr(c.text, (c.start - c.a + 1)::BIGINT, (c.stop - c.start)::BIGINT) AS evidence FROM cited c JOIN judged j ON j.query_id = c.query_id AND j.span_no = c.span_no"""

_GROUNDED = _cited_sql() + """,
sums AS (SELECT query_id, sum(length(text)) AS total, sum(coalesce(coverage, 0) * length(text)) AS weighted,
    sum(CASE status WHEN 'supported' THEN length(text) ELSE 0 END) AS sc, sum(CASE status WHEN 'partial' THEN length(text) ELSE 0 END) AS pc, sum(CASE status WHEN 'unsupported' THEN length(text) ELSE 0 END) AS uc,
    avg(coalesce(coverage, 0)) AS mean, min(coalesce(coverage, 0)) AS least, count(*) AS n, count_if(status = 'supported') AS s, count_if(status = 'partial') AS p, count_if(status = 'unsupported') AS u, count_if(coalesce(coverage, 1) < 0.4) AS weak FROM judged GROUP BY query_id),
ground AS (SELECT a.query_id, coalesce(weighted / total, 1.0) AS groundedness_score, 1.0 - coalesce(weighted / total, 1.0) AS hallucination_rate, coalesce(sc / total, 1.0) AS supported_ratio, coalesce(pc / total, 0.0) AS partial_ratio, coalesce(uc / total, 0.0) AS unsupported_ratio,
    coalesce(mean, 1.0) AS avg_confidence, coalesce(least, 1.0) AS min_confidence, coalesce(n, 0) AS num_spans, coalesce(s, 0) AS num_supported, coalesce(p, 0) AS num_partial, coalesce(u, 0) AS num_unsupported, coalesce(weak, 0) AS num_weak_citations
  FROM (SELECT DISTINCT query_id FROM answers) a LEFT JOIN sums USING (query_id))"""

_FACTS = _cited_sql() + """
SELECT a.query_id, count(j.span_no) AS num_claims, count_if(coalesce(coverage, 0) >= 0.6)::BIGINT AS num_verified, count_if(coalesce(coverage, 0) >= 0.3 AND coalesce(coverage, 0) < 0.6)::BIGINT AS num_partial, count_if(j.span_no IS NOT NULL AND coalesce(coverage, 0) < 0.3)::BIGINT AS num_unverified,
  round(coalesce(count_if(coalesce(coverage, 0) >= 0.6) / nullif(count(j.span_no), 0), 1.0), 9) AS verification_rate, round(coalesce(avg(CASE WHEN j.span_no IS NOT NULL THEN coalesce(coverage, 0) END), 1.0), 9) AS avg_confidence, round(coalesce(min(CASE WHEN j.span_no IS NOT NULL THEN coalesce(coverage, 0) END), 1.0), 9) AS min_confidence
FROM (SELECT DISTINCT query_id FROM answers) a LEFT JOIN judged j USING (query_id) GROUP BY a.query_id"""

_ANNOTATED = _cited_sql() + r""",
numbers AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY spot) AS number FROM (SELECT query_id, doc_id, min(span_no * 1000 + rank) AS spot FROM cited GROUP BY ALL)),
signs AS (SELECT query_id, span_no, string_agg('[' || number || ']', '' ORDER BY number) AS sign FROM (SELECT DISTINCT c.query_id, c.span_no, number FROM cited c JOIN numbers USING (query_id, doc_id)) GROUP BY ALL),
places AS (SELECT j.query_id, j.span_no, coalesce(sign, '[?]') AS sign, (b - (length(j.text) - length(regexp_replace(j.text, '[ 	

]+$', ''))))::BIGINT AS spot FROM judged j LEFT JOIN signs USING (query_id, span_no)),
cuts AS (SELECT *, coalesce(lag(spot) OVER (PARTITION BY query_id ORDER BY spot, span_no), 0) AS since FROM places),
done AS (SELECT query_id, string_agg(substr(whole, since + 1, spot - since) || sign, '' ORDER BY spot, span_no) AS head, max(spot) AS last FROM cuts JOIN answers USING (query_id) GROUP BY query_id)
SELECT query_id, CASE WHEN head IS NULL THEN whole ELSE head || substr(whole, last + 1) END AS annotated FROM answers LEFT JOIN done USING (query_id)"""

_SUMMARY = _cited_sql() + """,
ids AS (SELECT query_id, string_agg(id, ', ' ORDER BY id) AS ids FROM (SELECT DISTINCT query_id, doc_id::VARCHAR AS id FROM cited) GROUP BY query_id),
tally AS (SELECT query_id, count(*) AS n, count_if(status = 'supported') AS s, count_if(status = 'partial') AS p, count_if(status = 'unsupported') AS u FROM judged GROUP BY query_id)
SELECT query_id, CASE WHEN n IS NULL THEN 'Citation Summary: No spans to analyze' ELSE concat_ws(chr(10), 'Citation Summary:', '- ' || s || ' of ' || n || ' spans fully supported', CASE WHEN p > 0 THEN '- ' || p || ' spans partially supported' END,
  CASE WHEN u > 0 THEN '- ' || u || ' spans unsupported' END, '- Sources cited: ' || ids) END AS summary FROM (SELECT DISTINCT query_id FROM answers) LEFT JOIN tally USING (query_id) LEFT JOIN ids USING (query_id)"""

SQL: dict[str, str] = {
    "source_documents": "SELECT doc_id AS source_pos, doc_id::VARCHAR AS source_id, doc_id AS source_index, 0 AS base_doc_offset, lang, length(coalesce(text, ''))::INTEGER AS n FROM documents",
    "source_chunks": "SELECT doc_id AS source_pos, doc_id::VARCHAR AS source_id, 100 AS base_doc_offset, (100 + length(substr(text, 101)))::INTEGER AS chunk_end, length(substr(text, 101))::INTEGER AS n, length(text)::INTEGER AS n_full FROM documents",
    "segment_sources": f"WITH {_DOC_SENTENCES} SELECT doc_id, no::INTEGER AS sentence_no, text, a::INTEGER AS char_start, b::INTEGER AS char_end FROM sentences",
    "segment_answers": f"WITH {_TURNS} {_PARAGRAPHS} {_sentences_sql('paras', 'query_id, paragraph_index', False)} SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY a) - 1)::INTEGER AS span_no, paragraph_index, text, a::INTEGER AS char_start, b::INTEGER AS char_end FROM sentences",
    "passage_windows": f"""WITH {_DOC_SENTENCES},
n AS (SELECT doc_id, count(*) AS n FROM sentences GROUP BY doc_id),
w AS (SELECT doc_id, n, unnest(generate_series(0, greatest(0, ceil((n - 3) / 2)::BIGINT))) AS k FROM n)
SELECT w.doc_id AS source_pos, w.k::INTEGER AS passage_no, (2 * w.k)::INTEGER AS segment_start, least(w.n, 2 * w.k + 3)::INTEGER AS segment_end,
       f.a::INTEGER AS doc_char_start, l.b::INTEGER AS doc_char_end, md5(substr(d.text, f.a::BIGINT + 1, (l.b - f.a)::BIGINT)) AS digest
FROM w JOIN sentences f ON f.doc_id = w.doc_id AND f.no = 2 * w.k JOIN sentences l ON l.doc_id = w.doc_id AND l.no = least(w.n, 2 * w.k + 3) - 1 JOIN documents d ON d.doc_id = w.doc_id""",
    "tokenize": f"SELECT doc_id, len(k)::INTEGER AS n_tokens, md5(array_to_string(k, ' ')) AS digest FROM (SELECT doc_id, {_tokens_sql('text')} AS k FROM documents)",
    "token_idf": f"WITH {_DOC_SENTENCES}, {_IDF} SELECT token, df, round(idf, 9) AS idf FROM idf",
    "cosine_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
p AS (SELECT q.vec_id AS query, v.vec_id, list_dot_product(q.e, v.e) / sqrt(list_dot_product(q.e, q.e)) / sqrt(list_dot_product(v.e, v.e)) AS c FROM v q, v WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(c, 12) DESC, vec_id) AS rank FROM p)
SELECT query, vec_id, rank::INTEGER AS rank, round(c, 6) AS cosine FROM r WHERE rank <= 10""",
    "embedding_norms": "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings",
    "lexical_topn": f"WITH {_retrieved_sql(_SPANS, 20)} SELECT query_id, span_no::INTEGER AS span_no, cand AS candidate_index, rank::INTEGER AS rank, round(lexical, 9) AS lexical_score FROM best",
    "align_pairs": f"{_ALIGNED_ITEMS} SELECT {_ALIGNED_COLUMNS} FROM aligned",
    "align_topk": f"{_ALIGNED_ITEMS} SELECT * FROM ({_PLACED}) WHERE place <= 5",
    "align_best": f"{_ALIGNED_ITEMS} SELECT * FROM ({_PLACED}) WHERE place <= 1",
    "citations": f"{_cited_sql()} {_FLAT_SQL}",
    "citations_strict": f"{_cited_sql(CitationConfig.strict())} {_FLAT_SQL}",
    "status_counts": f"{_cited_sql()} SELECT status, count(*) AS n FROM judged GROUP BY status",
    "groundedness": f"{_GROUNDED} SELECT query_id, " + ", ".join(f"round({c}, 9) AS {c}" for c in ("groundedness_score", "hallucination_rate", "supported_ratio", "partial_ratio", "unsupported_ratio", "avg_confidence", "min_confidence")) + ", num_spans, " + ", ".join(f"{c}::BIGINT AS {c}" for c in ("num_supported", "num_partial", "num_unsupported", "num_weak_citations")) + " FROM ground",
    "is_grounded": f"{_GROUNDED} SELECT query_id, groundedness_score >= 0.5 AS is_grounded FROM ground",
    "is_hallucinated": f"{_GROUNDED} SELECT query_id, hallucination_rate > 0.5 AS is_hallucinated FROM ground",
    "verify_facts": _FACTS,
    "annotate_answer": _ANNOTATED,
    "citation_summary": _SUMMARY,
}
