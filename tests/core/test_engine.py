import pytest
from pyspark.sql import functions as F

from lodestar import api
from lodestar.config import CitationConfig, CitationWeights, FactVerificationConfig, HallucinationConfig
from lodestar.functions import segments, tokens
from lodestar.operators import grounding, passages, vectors
from lodestar.sources import adapters

PLAIN = CitationConfig(weights=CitationWeights(lexical=0.0, embedding=0.0))


def cite(spark, answer, sources, cfg=None, **how):
    return sorted(api.align_citations(*api.one_answer(spark, answer, sources), cfg, **how).collect(), key=lambda r: r.span_no)


def sentences(spark, text):
    return segments.with_sentences(spark.createDataFrame([(text,)], "text string")).first().segments


@pytest.mark.parametrize(
    "text,want",
    [("One. Two!", [(0, 4), (5, 9)]), ("", []), ("no end", [(0, 6)]), ("a; b\nc", [(0, 2), (3, 4), (5, 6)]), ("One.\n\n\n\nTwo.", [(0, 4), (8, 12)]), ("v1.2 is 😀. Yes", [(0, 10), (11, 14)]), (" \t\x1c ", [])],
)
def test_sentences(spark, text, want):
    got = sentences(spark, text)
    assert [(s.start, s.end) for s in got] == want and all(text[s.start : s.end] == s.text for s in got)


def test_long_texts_keep_their_offsets(spark):
    text = " ".join(f"s{k}." for k in range(3000))
    got = sentences(spark, text)
    assert len(got) == 3000 and all(text[s.start : s.end] == s.text for s in got)


def test_answer_spans_count_paragraphs(spark):
    text = "A one. B two; x\n \nC\nthree.\n\n\n\nD four  e."
    answers = spark.createDataFrame([(1, "a", text)], "query_id long, corpus_id string, answer string")
    got = passages.spans_of(answers).select("text", F.col("char_start").alias("start"), F.col("char_end").alias("end"), "paragraph_index").orderBy("span_no").collect()
    assert [(s.text, s.paragraph_index) for s in got] == [("A one.", 0), ("B two;", 0), ("x", 0), ("C\nthree.", 1), ("D four  e.", 2)]
    assert all(text[s.start : s.end] == s.text for s in got)


@pytest.mark.parametrize("size,stride,want", [(1, 1, [(0, 1), (1, 2), (2, 3)]), (2, 1, [(0, 2), (1, 3)]), (2, 2, [(0, 2), (2, 3)]), (5, 1, [(0, 3)]), (0, 0, [(0, 1), (1, 2), (2, 3)])])
def test_windows(spark, size, stride, want):
    t = "A a.  B b. C c."
    rows = segments.with_sentences(spark.createDataFrame([(t,)], "text string"))
    got = rows.select(segments.windows(F.col("segments"), F.col("text"), size, stride).alias("w")).first().w
    assert [(w.segment_start, w.segment_end) for w in got] == want and all(t[w.start : w.end] == w.text for w in got)


TEXTS = ["Hello, WORLD! Hello", "34% and 34 percent", "1,200 or 1200.5.", "state-of-the-art don't don’t -x- 'y", "café Ünï naïve", "$5 €6 £7", "", ".,!?", "a", "Straße ﬁne ² x²", "Ⅷ 1²,3", "x1-2a 3a4"]


def test_tokens_agree_between_paths(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    both = passages.with_tokens(rows, "text", lambda r: r)
    got = {r.i: r for r in both.withColumn("spans", tokens.token_spans(F.col("text"))).collect()}
    for i, t in enumerate(TEXTS):
        want, spans = tokens.tokens_with_spans(t)
        assert list(got[i].tokens) == want, t
        if tokens._PLAIN.match(t):
            assert [(s.start, s.end) for s in got[i].spans] == spans
    assert tokens.tokens_with_spans("34%")[0] == tokens.tokens_with_spans("34 percent")[0]
    assert tokens.tokens_with_spans("Straße")[0] == ["strasse"]


def test_needle_among_sources(spark):
    sources = [f"Filler number {k} says nothing of note. Other words here." for k in range(10)]
    sources[5] = "Some intro. The quick brown fox jumps over the lazy dog near the river bank. More."
    r = cite(spark, "The quick brown fox jumps over the lazy dog near the river bank.", sources, PLAIN)
    c = r[0].citations[0]
    assert r[0].status == "supported" and c.source_index == 5
    assert c.evidence == "The quick brown fox jumps over the lazy dog near the river bank" == sources[5][c.char_start : c.char_end]
    assert c.components["num_evidence_spans"] == 1.0 and c.components["answer_coverage"] == 1.0


def test_empty_inputs_and_limits(spark):
    assert [(r.status, len(r.citations)) for r in cite(spark, "One thing.", [])] == [("unsupported", 0)]
    assert cite(spark, "", ["text"]) == [] and cite(spark, " \n ", ["text"]) == []
    assert cite(spark, "One thing.", ["One thing."], CitationConfig(top_k=0)) == []
    assert cite(spark, "One thing.", ["One thing."], CitationConfig(min_alignment_score=10_000))[0].status == "unsupported"
    assert cite(spark, "One thing.", ["One thing."], CitationConfig(max_citations_per_source=0))[0].citations == []
    with pytest.raises(ValueError):
        cite(spark, "a", ["b"], backend="other")
    with pytest.raises(RuntimeError):
        cite(spark, "a", ["b"], backend="rust")


def test_metrics_are_exact(spark):
    seen = api.AlignmentMetrics()
    cite(spark, "One thing. Two things. !", ["One thing here. Another thing. Nothing.", "Two."], observation=seen)
    assert (seen.num_answer_spans, seen.num_candidates, seen.num_alignments) == (3, 4, 3)


def test_custom_segmenter_keeps_kind_and_paragraph(spark):
    from lodestar.functions.optional import by_paragraph

    halves = lambda t: [(0, len(t) // 2), (len(t) // 2, len(t))]
    answers, _ = api.one_answer(spark, "abcd\n\n  efgh", [])
    rows = api.spans_of(answers, by_paragraph(halves, "clause")).orderBy("span_no").collect()
    assert [(r.text, r.char_start, r.char_end, r.kind, r.paragraph_index, r.sentence_index) for r in rows] == [("ab", 0, 2, "clause", 0, 0), ("cd", 2, 4, "clause", 0, 1), ("ef", 8, 10, "clause", 1, 2), ("gh", 10, 12, "clause", 1, 3)]
    rows = api.spans_of(answers, halves).orderBy("span_no").collect()
    assert [(r.kind, r.paragraph_index) for r in rows] == [("sentence", None)] * 2


def test_long_chains_of_tokens(spark):
    long = ["a-" * 500_000 + "b", "1." * 500_000 + "1", "x'" * 500_000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(long)], "i int, t string")
    got = {r.i: r.n for r in rows.select("i", F.size(tokens.plain_tokens(F.col("t"))).alias("n")).collect()}
    assert got == {0: 1, 1: 1, 2: 1} and [len(tokens.scan(t)) for t in long] == [1, 1, 1]


def test_vectors_with_null_components(spark):
    from lodestar.operators.vectors import cosine_top

    rows = spark.createDataFrame([("c", 1, [1.0, 0.0]), ("c", 2, [None, 1.0]), ("c", 3, None), ("c", 4, [0.6, 0.8])], "corpus_id string, vec_id long, embedding array<double>")
    found = cosine_top(rows.withColumnRenamed("vec_id", "query"), rows, 5).orderBy("query", "rank").collect()
    assert [(r.query, r.vec_id, round(r.cosine, 6)) for r in found] == [(1, 1, 1.0), (1, 4, 0.6), (4, 4, 1.0), (4, 1, 0.6)]


def test_flags_of_other_libraries():
    assert adapters.LANGCHAIN_AVAILABLE == adapters.is_langchain_available() and adapters.LLAMAINDEX_AVAILABLE == adapters.is_llamaindex_available()
    assert (adapters.LangChainDocument is None) == (not adapters.LANGCHAIN_AVAILABLE) and (adapters.LlamaIndexNode is None) == (not adapters.LLAMAINDEX_AVAILABLE)


def test_two_sentence_evidence_needs_a_window(spark):
    source = ["The cat sat on the warm mat. The dog slept in the cold yard."]
    answer = "The cat sat on the warm mat the dog slept in the cold yard."
    strict = CitationConfig(min_answer_coverage=0.7)
    assert cite(spark, answer, source, strict)[0].status == "unsupported"
    assert cite(spark, answer, source, CitationConfig(min_answer_coverage=0.7, window_size_sentences=2))[0].status == "supported"


@pytest.mark.parametrize("gap,most,want", [(0, 5, [(0, 10), (17, 28)]), (30, 5, [(0, 28)]), (0, 1, [(0, 28)])])
def test_multi_span_evidence(spark, gap, most, want):
    text = "alpha beta xx yy gamma delta"
    cfg = CitationConfig(weights=PLAIN.weights, multi_span_evidence=True, multi_span_merge_gap_chars=gap, multi_span_max_spans=most)
    c = cite(spark, "alpha beta gamma delta", [text], cfg)[0].citations[0]
    assert [(s.char_start, s.char_end) for s in c.evidence_spans] == want
    assert all(text[s.char_start : s.char_end] == s.evidence for s in c.evidence_spans) and c.evidence == text


def test_chunks_have_absolute_offsets(spark):
    whole = "x" * 123 + "alpha beta gamma delta"
    rows = spark.createDataFrame([(0, "d", 123, "alpha beta gamma delta", None), (1, "e", 123, "alpha beta gamma", whole)], "position long, source string, start_index int, text string, whole string")
    for full in (None, "whole"):
        found = cite(spark, "alpha beta gamma", adapters.chunks(rows, full_text=full), PLAIN)[0].citations
        assert {c.source_id: (c.char_start, c.char_end, c.evidence) for c in found} == {"d": (123, 139, "alpha beta gamma"), "e": (123, 139, "alpha beta gamma")}


def test_embedding_only(spark):
    encode = lambda texts: [[1.0, 0.0] if "needle" in t else [0.0, 1.0] for t in texts]
    cfg = CitationConfig(weights=CitationWeights(0, 0, 0, 0, 1.0), max_candidates_lexical=0, min_alignment_score=10_000, allow_embedding_only=True)
    r = cite(spark, "Find the needle.", ["A needle here. Other words."], cfg, embedder=encode)[0]
    assert r.status == "supported" and r.citations[0].evidence == "A needle here." and r.citations[0].components["embedding_only"] == 1.0
    assert len(r.citations) == 1


def test_lexical_paths_agree(spark, monkeypatch):
    from lodestar.operators import lexical

    answers = spark.createDataFrame([(1, "a", "the red fox. the blue sea"), (2, "b", "green fox")], "query_id long, corpus_id string, answer string")
    sources = spark.createDataFrame([("a", k, f"the {w} fox and the sea. red {w}") for k, w in enumerate(("red", "blue", "green", "red"))] + [("b", 0, "a green fox. the sea")], "corpus_id string, p long, text string")
    passages_ = api.prepare_passages(adapters.documents(sources, position="p", corpus="corpus_id"))
    spans = api.prepare_spans(answers)
    idf = lexical.inverse_document_frequency(passages_)
    found = []
    for most, joined in ((20_000, 0), (1, 10**9), (1, 0)):
        monkeypatch.setattr(lexical, "SPANS", most)
        monkeypatch.setattr(lexical, "JOINED", joined)
        found.append(sorted(map(str, lexical.lexical_top(spans, passages_, idf, 3).collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) == 7


def spans_table(spark, rows):
    """rows: (length, coverage or None, status)"""
    schema = "query_id long, corpus_id string, span_no int, text string, char_start int, char_end int, citations array<struct<rank:int,score:double,source_id:string,components:map<string,double>>>, status string"
    return spark.createDataFrame([(1, "a", k, "x" * n, 0, n, [] if c is None else [(1, 1.0, f"s{k}", {"answer_coverage": c})], s) for k, (n, c, s) in enumerate(rows)], schema)


@pytest.mark.parametrize(
    "rows,cfg,want",
    [
        ([(16, 0.9, "supported")], {}, {"groundedness_score": 0.9, "num_supported": 1}),
        ([(19, 0.8, "supported"), (19, None, "unsupported")], {}, {"groundedness_score": 0.4, "supported_ratio": 0.5, "unsupported_ratio": 0.5}),
        ([(10, 0.5, "partial")], {}, {"groundedness_score": 0.5}),
        ([(10, 0.5, "partial")], {"include_partial_in_grounded": False}, {"groundedness_score": 0.0, "hallucination_rate": 1.0}),
        ([(10, 0.3, "partial")], {}, {"num_weak_citations": 1}),
        ([(10, 0.5, "partial")], {"weak_citation_threshold": 0.6}, {"num_weak_citations": 1}),
        ([(10, 0.9, "supported"), (10, 0.3, "partial")], {}, {"avg_confidence": 0.6, "min_confidence": 0.3}),
    ],
)
def test_groundedness(spark, rows, cfg, want):
    m = api.compute_hallucination_metrics(spans_table(spark, rows), config=HallucinationConfig(**cfg)).first().asDict()
    assert {k: m[k] for k in want} == pytest.approx(want)


def test_empty_answers_have_metrics(spark):
    answers, sources = api.one_answer(spark, "", ["x"])
    m = api.check_groundedness(answers, sources).first()
    assert (m.groundedness_score, m.hallucination_rate, m.supported_ratio, m.avg_confidence, m.min_confidence, m.num_spans, m.unsupported_spans) == (1.0, 0.0, 1.0, 1.0, 1.0, 0, [])
    f = api.verify_facts(answers, sources).first()
    assert (f.num_claims, f.verification_rate, f.avg_confidence, f.min_confidence, f.verified_claims) == (0, 1.0, 1.0, 1.0, [])


def test_facts(spark):
    source = ["The bridge opened in 1932 after eight years of work."]
    answers, sources = api.one_answer(spark, "The bridge opened in 1932 after eight years of work. Penguins govern seventeen distant moons.", source)
    f = api.verify_facts(answers, sources).first()
    assert (f.num_claims, f.num_verified, f.num_unverified, f.verification_rate) == (2, 1, 1, 0.5)
    assert [c.claim_no for c in f.verified_claims] == [0]
    lenient = api.verify_facts(answers, sources, FactVerificationConfig(verified_coverage_threshold=0.1)).first()
    assert lenient.num_verified >= 1
    assert api.is_grounded(answers, sources).first()[1] != api.is_hallucinated(answers, sources).first()[1]


@pytest.mark.parametrize("format,mark", [("markdown", "[1]"), ("superscript", "^1"), ("footnote", "[^1]")])
def test_annotation(spark, format, mark):
    answers, sources = api.one_answer(spark, "Red foxes run fast.\n\nPurple zebras sing.", ["Red foxes run fast."])
    got = api.annotate_answer(answers, sources, format=format).first().annotated
    assert got == f"Red foxes run fast.{mark}\n\nPurple zebras sing.[?]"
    plain = api.annotate_answer(answers, sources, format=format, include_unsupported=False).first().annotated
    assert plain == f"Red foxes run fast.{mark}\n\nPurple zebras sing."


def test_summary(spark):
    answers, sources = api.one_answer(spark, "Red foxes run fast. Purple zebras sing.", ["Red foxes run fast."])
    cited = api.align_citations(answers, sources)
    assert api.get_citation_summary(cited).first().summary == "Citation Summary:\n- 1 of 2 spans fully supported\n- 1 spans unsupported\n- Sources cited: 0"
    assert api.get_citation_summary(cited.limit(0), answers).first().summary == "Citation Summary: No spans to analyze"


def test_adapters(spark):
    class Doc:
        def __init__(self, text, **metadata):
            self.page_content = self.text = text
            self.metadata = metadata

    rows = adapters.from_dicts(spark, [{"id": "x", "text": "T", "k": 1}, {"text": "U"}]).collect()
    assert [(r.source_id, r.text, r.metadata) for r in rows] == [("x", "T", {"k": "1"}), ("1", "U", {})]
    c = adapters.from_langchain_chunks(spark, [Doc("abc", source="s", start_index=100)]).first()
    assert (c.source_id, c.base_doc_offset, c.source_index) == ("s", 100, 0)
    n = adapters.from_llamaindex_chunks(spark, [Doc("abc", file_name="f", start_char_idx=None)]).first()
    assert (n.source_id, n.base_doc_offset, n.full_text) == ("f", 0, None)
    assert adapters.from_langchain_documents(spark, [Doc("q")]).first().source_id == "0"
    assert not adapters.is_langchain_document(Doc("q")) and not adapters.is_llamaindex_node(1)
    if not adapters.is_langchain_available():
        with pytest.raises(ImportError):
            adapters.require_langchain()


def test_cosine_top_k(spark):
    v = spark.createDataFrame([("a", 1, [1.0, 0.0]), ("a", 2, [0.0, 0.0]), ("a", 3, [1.0, 1.0]), ("a", 4, [2.0, 0.0]), ("b", 5, [1.0, 0.0])], "corpus_id string, vec_id long, embedding array<float>")
    q = spark.createDataFrame([("q", "a", [1.0, 0.0]), ("z", "a", [0.0, 0.0])], "query string, corpus_id string, embedding array<float>")
    assert [(r.query, r.vec_id) for r in vectors.cosine_top(q, v, 4).orderBy("rank").collect()] == [("q", 1), ("q", 4), ("q", 3)]
    assert [(r.query, r.vec_id) for r in vectors.cosine_top(q, v, 2).orderBy("rank").collect()] == [("q", 1), ("q", 4)]
    assert vectors.cosine_top(q, v, 0).collect() == []


def test_best_citation_decides_confidence(spark):
    rows = grounding.span_confidences(spans_table(spark, [(5, 0.35, "partial")])).first()
    assert (rows.confidence, rows.weak, rows.is_grounded, rows.source_ids) == (0.35, True, True, ["s0"])


def test_sources_are_cut_as_by_expressions(spark):
    """Passages and tokens by the Python cutter are those of the built-in expressions."""
    from lodestar.functions import cutting

    texts = [*TEXTS, "One. Two!", "a; b\nc", "One.\n\n\nTwo.", "v1.2 is 😀. Yes", " \t\x1c ", "A a.  B b. C c.;;d;\x85e? f! g", "1,200. 5% ’x’; Straße ² x²\n$5."]
    for size, stride in ((1, 1), (2, 1), (2, 2), (5, 1), (3, 2), (0, 0)):
        rows = adapters.from_texts(spark, texts)
        want = {}
        for r in passages.with_tokens(rows, "text", lambda x: passages.passages_of(x, size, stride)).collect():
            want.setdefault(r.source_pos, []).append((r.passage_no, r.doc_char_start, r.doc_char_end, r.segment_start, r.segment_end, r.text, list(r.tokens)))
        cut = cutting.tokenizer()
        for r in rows.collect():
            parts = cutting.passages(r.text, size, stride)
            got = [(k, *p, r.text[p[0] : p[1]], t) for k, (p, t) in enumerate(zip(parts, cut(r.text, parts), strict=True))]
            assert got == sorted(want.get(r.source_pos, [])), (size, stride, r.text)


def test_best_passages_need_no_table_of_all(spark, monkeypatch):
    """Retrieval over sources gives the rows of all scores, ties by position, whatever the blocks; a passage is not read twice."""
    import random

    from lodestar.operators import lexical, retrieval

    rng = random.Random(3)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 60}"
    rows = [(c, p, " ".join(word() for _ in range(rng.randint(1, 9))) + ". " + " ".join(word() for _ in range(rng.randint(0, 9)))) for c in "ab" for p in range(150)]
    sources = adapters.documents(spark.createDataFrame(rows, "corpus_id string, p long, text string"), position="p", corpus="corpus_id").repartition(3)
    answers = spark.createDataFrame([(k, "ab"[k % 2], " ".join(word() for _ in range(rng.randint(1, 8)))) for k in range(30)] + [(30, "c", "w1"), (31, "a", "w1 unheard")], "query_id long, corpus_id string, answer string")
    spans = api.prepare_spans(answers)
    table = api.prepare_passages(sources)
    idf = lexical.inverse_document_frequency(table)
    want = sorted(map(str, lexical._best(lexical.lexical_scores(spans, table, idf), 7).select("query_id", "span_no", "candidate_index", "rank", "source_index", "lexical_score").collect()))
    monkeypatch.setattr(api, "prepare_passages", None)
    for most, cells, run in ((10**6, 4_000_000, 20_000), (10**6, 200, 16), (50, 4_000_000, 16)):
        monkeypatch.setattr(lexical, "BEST", most)
        monkeypatch.setattr(retrieval, "CELLS", cells)
        monkeypatch.setattr(retrieval, "PASSAGES", run)
        of = lexical.Sources(spans, sources, 7)
        assert sorted(map(str, of.top.select("query_id", "span_no", "candidate_index", "rank", "source_index", "lexical_score").collect())) == want
    texts = {(r.corpus_id, r.candidate_index): r.text for r in table.collect()}
    assert all(texts[r.corpus_id, r.candidate_index] == r.text for r in of.texts.collect())
    assert of.count() == len(texts)
    assert len(api.align_citations(answers, sources).collect()) == 32


@pytest.mark.parametrize("scale", [1, 2**46])
def test_scorer_is_exact_for_any_weights(scale):
    """Light terms, ties, runs of any size, and weights whose sums doubles would round."""
    import numpy as np

    from lodestar.operators.retrieval import Scorer, packed

    rng = np.random.default_rng(5)
    v, many, n, most = 40, 900, 25, 6
    has = rng.random((many, v)) < 1 / np.arange(1, v + 1)
    want_of = rng.random((n, v)) < 0.25
    w = np.sort(rng.integers(1, 50, v)) * scale + rng.integers(0, 2, v)
    src, no = rng.integers(0, 30, many), np.arange(many)
    owner, term = np.nonzero(want_of)
    order = np.lexsort((w[term], owner))
    owner, term = owner[order], term[order]
    s = Scorer(most, n, owner, term + 1, w[term], np.zeros(n, np.int64), v)
    for lo in range(0, many, 70):
        part = has[lo : lo + 70]
        s.add(packed(part.sum(axis=1), np.nonzero(part)[1] + 1, np.arange(len(part)), no[lo : lo + 70] * 0, no[lo : lo + 70], src[lo : lo + 70]))
    s.trim()
    got = {}
    for i, p, place in s.kept:
        for a, b, c in zip(i.tolist(), p.tolist(), place.tolist(), strict=True):
            got.setdefault(a, []).append((-b, *c))
    for i in range(n):
        sums = [(-sum(int(x) for x in w[want_of[i] & has[d]]), int(src[d]), d, 0) for d in range(many)]
        assert sorted(got.get(i, [])) == sorted(x for x in sums if x[0] < 0)[:most]


def test_token_digests_hold_a_bounded_length_of_texts(spark, monkeypatch):
    """Rows come by chunks of a batch, and are those of the expressions, a null text's null."""
    import pyarrow as pa

    from lodestar.functions import cutting

    run = cutting.token_digests()
    monkeypatch.setattr(cutting, "chunked", lambda batch, at, most=40, f=cutting.chunked: f(batch, at, most))
    texts = [*TEXTS, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    got = list(run([batch]))
    assert len(got) > 3 and max(b.num_rows for b in got) < len(texts)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = passages.with_tokens(rows, "text", lambda r: r).select("doc_id", F.when(F.col("text").isNotNull(), F.size("tokens")), F.md5(F.array_join("tokens", " "))).orderBy("doc_id").collect()
    assert [tuple(r.values()) for b in got for r in b.to_pylist()] == [tuple(r) for r in want]


def test_cosine_products_are_taken_by_tiles(spark, monkeypatch):
    """No product is larger than a tile, however many rows a batch has; the best are those of all pairs, ties by id."""
    import numpy as np

    monkeypatch.setattr(vectors, "TILE", 8)
    monkeypatch.setattr(vectors, "ROWS", 16)
    v = np.random.default_rng(2).integers(-2, 3, (150, 3)).astype(float)
    rows = spark.createDataFrame([("c", k, x.tolist()) for k, x in enumerate(v)], "corpus_id string, vec_id long, embedding array<double>").coalesce(1)
    got = vectors.cosine_top(rows.where("vec_id % 5 = 0").withColumnRenamed("vec_id", "query"), rows, 4)
    found = {(r.query, r.rank): round(r.cosine, 9) for r in got.collect()}
    size = np.sqrt((v * v).sum(axis=1))
    for q in range(0, 150, 5):
        if size[q]:
            cos = np.sort(np.round(v @ v[q] / np.where(size == 0, 1, size) / size[q], 9))[::-1][:4]
            assert [found[q, k + 1] for k in range(4)] == cos.tolist()
