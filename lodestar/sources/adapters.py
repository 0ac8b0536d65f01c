"""Source tables from DataFrames, from dictionaries, and from other libraries' document objects.

A document stands at offset 0 of itself. A chunk stands at its start in a longer document, whose text may be given;
several chunks may share a source_id. Metadata only pass through.
"""

from __future__ import annotations

from collections.abc import Sequence
from importlib import import_module
from importlib.util import find_spec

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("corpus_id", T.StringType()),
        T.StructField("source_pos", T.LongType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("source_index", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("base_doc_offset", T.IntegerType()),
        T.StructField("full_text", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)


def _shaped(rows: DataFrame, corpus_id, pos, source_id, index, text, offset, full_text, metadata) -> DataFrame:
    values = (corpus_id, pos, source_id, index, text, offset, full_text, metadata)
    return rows.select(*[v.cast(f.dataType).alias(f.name) for v, f in zip(values, SCHEMA.fields, strict=True)])


def _rest(rows: DataFrame, used: set[str]) -> Column:
    names = [c for c in rows.columns if c not in used]
    if not names:
        return F.create_map().cast("map<string,string>")
    return F.map_from_arrays(F.array(*[F.lit(c) for c in names]), F.array(*[F.col(c).cast("string") for c in names]))


def documents(rows: DataFrame, text: str = "text", source_id: str | None = None, position: str | None = None, corpus: str | None = None) -> DataFrame:
    """Whole documents as sources. Without an id, a source is named by its position; a null text is empty."""
    pos = F.col(position) if position else F.monotonically_increasing_id()
    name = F.coalesce(F.col(source_id).cast("string"), pos.cast("string")) if source_id else pos.cast("string")
    used = {text, source_id, position, corpus}
    return _shaped(rows, F.col(corpus) if corpus else F.lit("all"), pos, name, pos, F.coalesce(F.col(text), F.lit("")), F.lit(0), F.lit(None), _rest(rows, used))


def chunks(rows: DataFrame, text: str = "text", source_id: str = "source", start: str = "start_index", end: str = "end_index", full_text: str | None = None, position: str = "position", corpus: str | None = None) -> DataFrame:
    """Chunks as sources: start defaults to 0. end is only checked against the text's length by whoever made it."""
    pos = F.col(position)
    offset = F.coalesce(F.col(start), F.lit(0)) if start in rows.columns else F.lit(0)
    used = {text, source_id, start, end, full_text, position, corpus}
    return _shaped(rows, F.col(corpus) if corpus else F.lit("all"), pos, F.coalesce(F.col(source_id).cast("string"), pos.cast("string")), pos, F.coalesce(F.col(text), F.lit("")), offset, F.col(full_text) if full_text else F.lit(None), _rest(rows, used))


def chunk_ends(rows: DataFrame, text: str = "text", start: str = "start_index", end: str = "end_index") -> Column:
    """Where a chunk ends: as given, else its start plus its length."""
    first = F.coalesce(F.col(start), F.lit(0)) if start in rows.columns else F.lit(0)
    length = first + F.length(F.coalesce(F.col(text), F.lit("")))
    return F.coalesce(F.col(end), length) if end in rows.columns else length


def _table(spark: SparkSession, rows: list[dict], corpus_id: str) -> DataFrame:
    full = [
        (corpus_id, k, str(r["id"]), r.get("index", k), r["text"] or "", int(r.get("offset", 0)), r.get("full_text"), {str(a): None if b is None else str(b) for a, b in r.get("metadata", {}).items()})
        for k, r in enumerate(rows)
    ]
    return spark.createDataFrame(full, SCHEMA)


def from_texts(spark: SparkSession, texts: Sequence[str], corpus_id: str = "all") -> DataFrame:
    return _table(spark, [{"id": k, "text": t} for k, t in enumerate(texts)], corpus_id)


def from_dicts(spark: SparkSession, documents: Sequence[dict], text_key: str = "text", id_key: str = "id", corpus_id: str = "all") -> DataFrame:
    """A missing text is empty, a missing id is the position; all other keys are metadata."""
    return _table(spark, [{"id": d.get(id_key, k), "text": d.get(text_key, ""), "metadata": {a: b for a, b in d.items() if a not in (text_key, id_key)}} for k, d in enumerate(documents)], corpus_id)


def from_langchain_documents(spark: SparkSession, documents: Sequence, id_key: str = "source", corpus_id: str = "all") -> DataFrame:
    """Objects with page_content and metadata; the id falls back to the position."""
    return _table(spark, [{"id": d.metadata.get(id_key, k), "text": d.page_content, "metadata": d.metadata} for k, d in enumerate(documents)], corpus_id)


def from_langchain_chunks(spark: SparkSession, documents: Sequence, id_key: str = "source", start_key: str = "start_index", end_key: str = "end_index", full_text_key: str | None = None, corpus_id: str = "all") -> DataFrame:
    return _table(spark, [{"id": d.metadata.get(id_key, k), "text": d.page_content, "offset": d.metadata.get(start_key, 0), "full_text": d.metadata.get(full_text_key) if full_text_key else None, "metadata": d.metadata} for k, d in enumerate(documents)], corpus_id)


def _bare(node):
    return getattr(node, "node", node)


def _content(node) -> str:
    return node.get_content() if hasattr(node, "get_content") else node.text


def from_llamaindex_nodes(spark: SparkSession, nodes: Sequence, id_key: str = "file_name", corpus_id: str = "all") -> DataFrame:
    """Nodes, or nodes wrapped with a score; the id comes from metadata or is the position."""
    bare = [_bare(n) for n in nodes]
    return _table(spark, [{"id": n.metadata.get(id_key, k), "text": _content(n), "metadata": n.metadata} for k, n in enumerate(bare)], corpus_id)


def from_llamaindex_chunks(spark: SparkSession, nodes: Sequence, id_key: str = "file_name", start_key: str = "start_char_idx", end_key: str = "end_char_idx", corpus_id: str = "all") -> DataFrame:
    """Offsets come from metadata only; a start of None is 0."""
    bare = [_bare(n) for n in nodes]
    return _table(spark, [{"id": n.metadata.get(id_key, k), "text": _content(n), "offset": n.metadata.get(start_key) or 0, "metadata": n.metadata} for k, n in enumerate(bare)], corpus_id)


def is_langchain_available() -> bool:
    return find_spec("langchain_core") is not None


def is_llamaindex_available() -> bool:
    try:
        return find_spec("llama_index.core") is not None
    except ModuleNotFoundError:
        return False


#: whether the libraries are there, as of the import of this module
LANGCHAIN_AVAILABLE, LLAMAINDEX_AVAILABLE = is_langchain_available(), is_llamaindex_available()


def __getattr__(name: str):
    """The other libraries' classes under the names of the handles, imported when asked for; None without the library."""
    if name == "LangChainDocument":
        return import_module("langchain_core.documents").Document if LANGCHAIN_AVAILABLE else None
    if name in ("LlamaIndexTextNode", "LlamaIndexNodeWithScore", "LlamaIndexNode"):
        if not LLAMAINDEX_AVAILABLE:
            return None
        schema = import_module("llama_index.core.schema")
        known = {"LlamaIndexTextNode": schema.TextNode, "LlamaIndexNodeWithScore": schema.NodeWithScore}
        return known.get(name, (schema.TextNode, schema.NodeWithScore))
    raise AttributeError(name)


def is_langchain_document(value) -> bool:
    if not is_langchain_available():
        return False
    from langchain_core.documents import Document

    return isinstance(value, Document)


def is_llamaindex_node(value) -> bool:
    if not is_llamaindex_available():
        return False
    from llama_index.core.schema import BaseNode, NodeWithScore

    return isinstance(value, BaseNode | NodeWithScore)


def require_langchain() -> None:
    if not is_langchain_available():
        raise ImportError("langchain-core is not installed: pip install langchain-core")


def require_llamaindex() -> None:
    if not is_llamaindex_available():
        raise ImportError("llama-index-core is not installed: pip install llama-index-core")


def read_sources(spark: SparkSession, path: str, format: str = "parquet", schema=None, **columns) -> DataFrame:
    """Documents of a file or table in any format that Spark reads; columns as documents() takes them."""
    reader = spark.read.format(format)
    return documents((reader.schema(schema) if schema else reader).load(path), **columns)


def write_citations(found: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists") -> None:
    found.write.format(format).mode(mode).save(path)
