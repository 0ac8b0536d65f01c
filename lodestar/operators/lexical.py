"""Lexical retrieval: passages ranked for each span by the share of the span's token weight that they hold.

A pass over the sources or passages keeps the tokens that spans have as numbers; blocks of spans are broadcast and scored
against these where they lie (see retrieval), and only the best of what a task sees leave it. Of prepared passages, more
spans than a block take an inverted-index join on the token, if its rows, which are counted first, are not too many: many
answers with small corpora of their own. All ways give the same rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..config import TokenizerConfig
from ..functions.cutting import passages as cut_passages
from ..plans.stage import materialised
from .passages import firsts
from .retrieval import BLOB, blob_rows, encoded, encoder, scored, token_counter

#: spans that are broadcast at most
SPANS = 20_000
#: best passages of all spans of a block at most
BEST = 2_000_000
#: rows of the inverted-index join at most
JOINED = 1_000_000_000
#: scores are sums of weights in steps of this, so they don't depend on the order of addition
STEP = 10**12
SPAN = ["query_id", "corpus_id", "span_no"]


def document_frequency(passages: DataFrame) -> DataFrame:
    """corpus_id, token, df: in how many passages of a corpus a token stands."""
    return passages.select("corpus_id", F.explode_outer(F.array_distinct("tokens")).alias("token")).where("token is not null").groupBy("corpus_id", "token").agg(F.count("*").alias("df"))


def inverse_document_frequency(passages: DataFrame) -> DataFrame:
    """corpus_id, token, df, idf = ln((n + 1) / (df + 1)) + 1, where n counts all passages, those without tokens too."""
    n = passages.groupBy("corpus_id").agg(F.count("*").alias("n"))
    return document_frequency(passages).join(n, "corpus_id").select("corpus_id", "token", "df", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def weighted_spans(spans: DataFrame, idf: DataFrame) -> DataFrame:
    """query_id, corpus_id, span_no, token, w: distinct tokens of spans; one that no passage has weighs 1. w is in steps."""
    tokens = spans.select("query_id", "corpus_id", "span_no", F.explode(F.array_distinct("tokens")).alias("token"))
    return tokens.join(idf.select("corpus_id", "token", "idf"), ["corpus_id", "token"], "left").select("query_id", "corpus_id", "span_no", "token", F.round(F.coalesce("idf", F.lit(1.0)) * STEP).cast("long").alias("w"))


def lexical_scores(spans: DataFrame, passages: DataFrame, idf: DataFrame) -> DataFrame:
    """query_id, corpus_id, span_no, candidate_index, source_index, lexical_score of every pair that shares a token."""
    w = weighted_spans(spans, idf)
    total = w.groupBy("query_id", "corpus_id", "span_no").agg(F.sum("w").alias("total"))
    postings = passages.select("corpus_id", "candidate_index", "source_index", F.explode(F.array_distinct("tokens")).alias("token"))
    shared = w.join(postings, ["corpus_id", "token"]).groupBy("query_id", "corpus_id", "span_no", "candidate_index", "source_index").agg(F.sum("w").alias("part"))
    return shared.join(total, ["query_id", "corpus_id", "span_no"]).select("query_id", "corpus_id", "span_no", "candidate_index", "source_index", (F.col("part") / F.col("total")).alias("lexical_score"))


def _best(rows: DataFrame, most: int) -> DataFrame:
    by = W.partitionBy("query_id", "span_no").orderBy(F.desc("lexical_score"), "source_index", "candidate_index")
    return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most)


def lexical_top(spans: DataFrame, passages: DataFrame, idf: DataFrame, most: int) -> DataFrame:
    """The `most` best rows of lexical_scores() for each span, with rank, by (score, source_index, candidate_index)."""
    if most <= 0:
        return _best(lexical_scores(spans.limit(0), passages, idf), 0)
    if spans.count() > SPANS:
        by_token = weighted_spans(spans, idf).groupBy("corpus_id", "token").agg(F.count("*").alias("n"))
        load = by_token.join(idf, ["corpus_id", "token"]).agg(F.sum(F.col("n") * F.col("df"))).first()[0] or 0
        if load <= JOINED:
            return _best(lexical_scores(spans, passages, idf), most)
    lexicon = Lexicon(spans)
    numbers, names = lexicon.known, lexicon.names

    def run(source):
        known, n_terms = numbers.value, len(names.value)
        df = np.zeros(n_terms + 1, np.int64)
        for batch in source:
            columns = [batch.column(k).to_pylist() for k in range(4)]
            rows = ((c, at, src, [tokens or []]) for c, at, src, tokens in zip(*columns, strict=True))
            for terms, blob in encoded(rows, known, n_terms):
                df += np.bincount(terms, minlength=n_terms + 1)
                yield blob_rows([], [], [], [], [blob])
        found = np.flatnonzero(df)
        if len(found):
            yield blob_rows([names.value[k - 1][0] for k in found], [names.value[k - 1][1] for k in found], [], df[found], [])

    # the numbers of passages stand for positions, a null source index for the least
    blobs = materialised(passages.select("corpus_id", "candidate_index", F.coalesce("source_index", F.lit(NONE)), "tokens").mapInArrow(run, BLOB))
    found = _scored(spans, blobs, idf, lexicon, most)
    by = W.partitionBy("k").orderBy(F.desc("lexical_score"), "source_index", "source_pos")
    found = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most)
    return found.join(lexicon.spans, "k").select(*SPAN, F.col("source_pos").alias("candidate_index"), _index("source_index"), "lexical_score", "rank")


#: stands for a null source index, which comes first
NONE = -(1 << 63)


def _index(column: str):
    return F.when(F.col(column) != NONE, F.col(column)).alias(column)


class Lexicon:
    """Numbers, from 1, of the tokens that spans have, broadcast both ways; spans of the same tokens share a needle k."""

    def __init__(self, spans: DataFrame):
        self.session = spans.sparkSession
        each = spans.select("corpus_id", F.explode(F.array_distinct("tokens")).alias("token")).distinct()
        self.tokens = materialised(each)
        table = self.tokens.toArrow()
        names = list(zip(table["corpus_id"].to_pylist(), table["token"].to_pylist(), strict=True))
        known: dict = {}
        for k, (corpus, token) in enumerate(names, 1):
            known.setdefault(corpus, {})[token] = k
        sc = self.session.sparkContext
        self.known, self.names, self.spans, self._known = sc.broadcast(known), sc.broadcast(names), None, known

    def weights(self, idf: DataFrame, df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """The weight of each token, in steps, and in how many passages it stands; one that idf doesn't name weighs 1."""
        w, n = np.full(len(self.names.value) + 1, STEP, np.int64), np.zeros(len(self.names.value) + 1, np.int64)
        found = self.tokens.join(idf.select("corpus_id", "token", F.round(F.col("idf") * STEP).cast("long").alias("x")), ["corpus_id", "token"])
        for values, rows in ((w, found), (n, df.select("corpus_id", "token", F.col("df").alias("x")))):
            table = rows.toArrow()
            at = [self._known[c][t] for c, t in zip(table["corpus_id"].to_pylist(), table["token"].to_pylist(), strict=True)]
            values[at] = table["x"].to_numpy()
        return w, n

    def needles(self, spans: DataFrame, most: int, w: np.ndarray, df: np.ndarray):
        """Scorer()'s arguments for spans, the total weight of each needle, and the needle of each span."""
        table = spans.select(*SPAN, F.array_distinct("tokens").alias("t")).toArrow()
        numbers, k_of, terms = {}, [], []
        for corpus, tokens in zip(table["corpus_id"].to_pylist(), table["t"].to_pylist(), strict=True):
            key = tuple(sorted(self._known[corpus][t] for t in tokens or () if t is not None))
            if key and key not in numbers:
                numbers[key] = len(terms)
                terms.append(key)
            k_of.append(numbers.get(key))
        owner = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
        term = np.array([t for key in terms for t in key], np.int64)
        order = np.lexsort((w[term], owner))
        term = term[order]
        floor = np.zeros(len(terms), np.int64)
        many = df[term] >= most  # passages enough have it
        np.maximum.at(floor, owner[many], w[term[many]])
        total = np.zeros(len(terms), np.int64)
        np.add.at(total, owner, w[term])
        named = table.select(SPAN).append_column("k", pa.array(k_of, pa.int64()))
        return (len(terms), owner, term, w[term], floor, len(w) - 1), total, named


def _scored(spans: DataFrame, blobs: DataFrame, idf: DataFrame, lexicon: Lexicon, most: int) -> DataFrame:
    """(k, source_index, source_pos, passage_no, lexical_score) of passages, among them the best of each needle."""
    w, df = lexicon.weights(idf, counted(blobs))
    sc = spans.sparkSession.sparkContext
    n = spans.count()
    parts = max(1, -(-n // SPANS), -(-n * most // BEST))
    block = F.pmod(F.xxhash64("query_id", "span_no"), F.lit(parts))
    runs, names, totals, before = blobs.where("blob is not null").select("blob"), [], [], 0
    found = []
    for k in range(parts):
        args, total, named = lexicon.needles(spans.where(block == k) if parts > 1 else spans, most, w, df)
        if not len(total):
            names.append(named)
            continue
        rows = runs.mapInArrow(scored(sc.broadcast(list(args)), most), "k long, source_index long, source_pos long, passage_no long, part long")
        found.append(rows.withColumn("k", F.col("k") + before))
        names.append(named.set_column(3, "k", pa.array((x + before if x is not None else None for x in named["k"].to_pylist()), pa.int64())))
        totals.append(total)
        before += len(total)
    spark = spans.sparkSession
    kinds = [(f.name, f.dataType) for f in spans.select(*SPAN).schema.fields]
    named = spark.createDataFrame(pa.concat_tables(names))
    lexicon.spans = named.select(*[F.col(c).cast(kind).alias(c) for c, kind in kinds], "k").where("k is not null")
    if not found:
        return runs.limit(0).selectExpr("0L AS k", "0L AS source_index", "0L AS source_pos", "0L AS passage_no", "0D AS lexical_score")
    total = spark.createDataFrame(pa.table({"k": np.arange(before), "total": np.concatenate(totals)}))
    rows = reduce(DataFrame.unionAll, found).join(F.broadcast(total), "k")
    return rows.select("k", "source_index", "source_pos", "passage_no", (F.col("part") / F.col("total")).alias("lexical_score"))


def counted(blobs: DataFrame) -> DataFrame:
    """corpus_id, token, df of the tokens that were looked for."""
    return blobs.where("token is not null").groupBy("corpus_id", "token").agg(F.sum("n").alias("df"))


def frequencies(sources: DataFrame, size: int = 1, stride: int = 1, tokens: TokenizerConfig = TokenizerConfig()) -> DataFrame:
    """inverse_document_frequency() of the passages of sources, which nothing else needs."""
    rows = materialised(sources.select("corpus_id", "text").mapInArrow(token_counter(size, stride, tokens), "corpus_id string, token string, n long"))
    df = rows.where("token is not null").groupBy("corpus_id", "token").agg(F.sum("n").alias("df"))
    n = rows.where("token is null").groupBy("corpus_id").agg(F.sum("n").alias("n"))
    return _weighed(df, n)


def _weighed(df: DataFrame, n: DataFrame) -> DataFrame:
    return df.join(n, "corpus_id").select("corpus_id", "token", "df", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


class Sources:
    """The best passages of sources for each span, without a table of all passages: each source is cut once for all spans,
    and once more if it has one of the best.

    top: lexical_top()'s rows; texts: corpus_id, candidate_index, source_pos, source_id, base_doc_offset, doc_char_start,
    doc_char_end and text of the passages in it; count(): how many passages there are.
    """

    def __init__(self, spans: DataFrame, sources: DataFrame, most: int, size: int = 1, stride: int = 1, tokens: TokenizerConfig = TokenizerConfig()):
        self.sources, self.size, self.stride = sources.where("corpus_id is not null and source_pos is not null"), size, stride
        lexicon = Lexicon(spans)
        rows = self.sources.select("corpus_id", "source_pos", F.coalesce("source_index", F.lit(NONE)).alias("source_index"), "text")
        self.blobs = materialised(rows.mapInArrow(encoder(lexicon.known, lexicon.names, size, stride, tokens), BLOB))
        of_source = self.blobs.where("source_pos is not null").groupBy("corpus_id", "source_pos").agg(F.sum("n").alias("n"))
        idf = _weighed(counted(self.blobs), of_source.groupBy("corpus_id").agg(F.sum("n").alias("n")))
        found = _scored(spans, self.blobs, idf, lexicon, most)
        by = W.partitionBy("k").orderBy(F.desc("lexical_score"), "source_index", "source_pos", "passage_no")
        found = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most)
        found = found.join(lexicon.spans.select("k", "corpus_id").distinct(), "k")
        # passages are numbered by position, then within their source
        found = found.join(firsts(of_source), ["corpus_id", "source_pos"])
        self.found = materialised(found.select("k", "corpus_id", "source_pos", "passage_no", (F.col("first") + F.col("passage_no")).cast("long").alias("candidate_index"), _index("source_index"), "lexical_score", "rank"))
        self.top = self.found.join(lexicon.spans.drop("corpus_id"), "k").select(*SPAN, "candidate_index", "source_index", "lexical_score", "rank")
        self.few = len(lexicon.names.value) <= SPANS and spans.count() * most <= BEST

    def count(self) -> int:
        return self.blobs.where("source_pos is not null").agg(F.sum("n")).first()[0] or 0

    @property
    def texts(self) -> DataFrame:
        size, stride = self.size, self.stride

        def run(source):
            for batch in source:
                out: list[tuple] = []
                kept = [x.to_pylist() for x in batch.columns]
                for corpus, pos, name, base, text, numbers in zip(*kept, strict=True):
                    parts = cut_passages(text or "", size, stride)
                    out += [(corpus, n["candidate_index"], pos, name, base, parts[n["passage_no"]][0], parts[n["passage_no"]][1], text[parts[n["passage_no"]][0] : parts[n["passage_no"]][1]]) for n in numbers if n["passage_no"] < len(parts)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=TEXT)

        wanted = self.found.select("corpus_id", "source_pos", "passage_no", "candidate_index").distinct().groupBy("corpus_id", "source_pos").agg(F.collect_list(F.struct("passage_no", "candidate_index")).alias("numbers"))
        rows = self.sources.select("corpus_id", "source_pos", "source_id", "base_doc_offset", "text")
        # few positions go to the sources; else these are dealt with them
        rows = rows.join(F.broadcast(wanted) if self.few else wanted, ["corpus_id", "source_pos"])
        return rows.mapInArrow(run, "corpus_id string, candidate_index long, source_pos long, source_id string, base_doc_offset int, doc_char_start int, doc_char_end int, text string")


TEXT = ["corpus_id", "candidate_index", "source_pos", "source_id", "base_doc_offset", "doc_char_start", "doc_char_end", "text"]
