"""Answers into spans, sources into passages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..config import TokenizerConfig
from ..functions.segments import windows, with_paragraphs, with_sentences
from ..functions.tokens import PLAIN, arrow_tokens, plain_tokens

#: source positions in a block when passages are numbered
RANGE = 4096


def exploded(rows: DataFrame, array: str, out: str, position: str = "__pos") -> DataFrame:
    """A row for each element of an array. The outer form and a filter behind it keep the optimizer from computing the
    array once more, as a filter of its own, below."""
    names = [c for c in rows.columns if c != array]
    found = rows.select(*names, F.posexplode_outer(array).alias(position, out)).where(F.col(out).isNotNull())
    return found.drop("__pos")


def segmented(rows: DataFrame, text: str, segmenter) -> DataFrame:
    """rows with `segments`, by a function of a text that returns (start, end), or (start, end, kind) or (start, end,
    kind, paragraph); without these a segment is a sentence of no known paragraph. Runs in Arrow batches."""
    import pyarrow as pa
    from pyspark.sql.types import StructType

    at, names = rows.columns.index(text), rows.columns
    kind = pa.list_(pa.struct([("text", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("paragraph", pa.int32())]))

    def run(source):
        for batch in source:
            found = [[{"text": t[s[0] : s[1]], "start": s[0], "end": s[1], "kind": s[2] if len(s) > 2 else "sentence", "paragraph": s[3] if len(s) > 3 else None} for s in segmenter(t)] if t else [] for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*names, "segments"])

    added = StructType.fromDDL("segments array<struct<text:string,start:int,end:int,kind:string,paragraph:int>>")
    return rows.mapInArrow(run, StructType([*rows.schema.fields, *added.fields]))


def spans_of(answers: DataFrame, segmenter=None) -> DataFrame:
    """query_id, corpus_id, span_no, text, char_start, char_end, kind, paragraph_index, sentence_index of answers
    (query_id, corpus_id, answer)."""
    if segmenter is None:
        rows = with_paragraphs(answers.select("query_id", "corpus_id", "answer"), "answer", "paragraphs")
        rows = exploded(rows.select("query_id", "corpus_id", "paragraphs"), "paragraphs", "p", "paragraph_index")
        rows = with_sentences(rows.select("query_id", "corpus_id", "paragraph_index", F.col("p.text").alias("t"), F.col("p.start").alias("base")), "t", split_on_newlines=False)
        rows = exploded(rows.select("query_id", "corpus_id", "paragraph_index", "base", "segments"), "segments", "s")
    else:
        rows = segmented(answers.select("query_id", "corpus_id", "answer"), "answer", segmenter)
        rows = rows.select("query_id", "corpus_id", F.lit(0).alias("base"), F.explode("segments").alias("s"))
        rows = rows.select("query_id", "corpus_id", F.col("s.paragraph").alias("paragraph_index"), "base", "s")
    start = F.col("base") + F.col("s.start")
    no = (F.row_number().over(W.partitionBy("query_id", "corpus_id").orderBy("start")) - 1).cast("int")
    kind = F.lit("sentence") if segmenter is None else F.col("s.kind")
    rows = rows.select("query_id", "corpus_id", "paragraph_index", kind.alias("kind"), F.col("s.text").alias("text"), start.alias("start"), (start + F.length(F.col("s.text"))).alias("stop")).withColumn("span_no", no)
    return rows.select("query_id", "corpus_id", "span_no", "text", F.col("start").alias("char_start"), F.col("stop").alias("char_end"), "kind", "paragraph_index", F.col("span_no").alias("sentence_index"))


def passages_of(sources: DataFrame, size: int = 1, stride: int = 1, segmenter=None) -> DataFrame:
    """One row a passage of sources, not yet numbered: passage_no counts within its source."""
    if segmenter is None:
        rows = with_sentences(sources)
    else:
        rows = segmented(sources, "text", segmenter)
    rows = rows.withColumn("passages", windows(F.col("segments"), F.col("text"), size, stride))
    keep = [c for c in ("corpus_id", "source_pos", "source_id", "source_index", "base_doc_offset") if c in rows.columns]
    rows = exploded(rows.select(*keep, "passages"), "passages", "p", "passage_no")
    return rows.select(*keep, "passage_no", F.col("p.text").alias("text"), F.col("p.start").alias("doc_char_start"), F.col("p.end").alias("doc_char_end"), F.col("p.segment_start").alias("segment_start"), F.col("p.segment_end").alias("segment_end"))


def with_tokens(rows: DataFrame, text: str, build, tokens: TokenizerConfig = TokenizerConfig(), tokenizer=None, out: str = "text") -> DataFrame:
    """build(rows) with tokens of its column `out`. Rows of plain text go by built-in expressions, others by an Arrow
    function; each row is built once."""
    if tokenizer is not None:
        return arrow_tokens(build(rows), out, tokens, tokenizer)
    is_plain = F.coalesce(F.col(text), F.lit("")).rlike(PLAIN)
    simple = build(rows.where(is_plain))
    return simple.withColumn("tokens", plain_tokens(F.col(out), tokens)).unionByName(arrow_tokens(build(rows.where(~is_plain)), out, tokens))


def numbered(passages: DataFrame) -> DataFrame:
    """passages with candidate_index, dense within a corpus by (source_pos, passage_no)."""
    first = firsts(passages.groupBy("corpus_id", "source_pos").agg(F.count("*").alias("n")))
    return passages.join(first, ["corpus_id", "source_pos"]).withColumn("candidate_index", (F.col("first") + F.col("passage_no")).cast("long")).drop("first")


def firsts(n: DataFrame) -> DataFrame:
    """corpus_id, source_pos, first: the number of the first passage of each source, from how many each has (n).

    Counts of sources are summed by ranges of positions, so no task orders a whole corpus.
    """
    n = n.withColumn("range", F.floor(F.col("source_pos") / RANGE))
    ahead = W.partitionBy("corpus_id").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = n.groupBy("corpus_id", "range").agg(F.sum("n").alias("n")).select("corpus_id", "range", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    within = W.partitionBy("corpus_id", "range").orderBy("source_pos").rowsBetween(W.unboundedPreceding, -1)
    return n.join(ranges, ["corpus_id", "range"]).select("corpus_id", "source_pos", (F.col("base") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("first"))
