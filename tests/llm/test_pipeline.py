import os
import random
import re
from collections import defaultdict

import pytest
from test_ngram_join import brute

import corpus_pipeline
from lodestar.llm import runtime

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_stages_chain_and_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas(), docs.schema)
        assert docs.columns == columns, name
        now = docs.count()
        assert 0.5 * before < now <= before, name
        before = now
    rows = corpus_pipeline.run(spark, SF).toPandas()
    assert len(rows) == before and set(rows.doc_id) == {r.doc_id for r in docs.select("doc_id").collect()}


def words(text, cut=r"[^\x20\x09-\x0D]+"):
    return re.findall(cut, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def tables(spark, at, docs, labels, items):
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def corpus():
    """Documents with copies, near copies, shared lines, benchmark passages, junk, repeated ids, nulls and empty texts."""
    rng = random.Random(3)
    sentence = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    item = sentence(30)
    texts = ["\n".join(sentence(rng.randrange(6, 16)) for _ in range(rng.randrange(2, 7))) for _ in range(80)]
    texts += [texts[1], texts[2], texts[3].replace(texts[3].split()[2], "changed"), texts[4] + " more"]
    texts += [sentence(20) + "\n" + texts[5].split("\n")[0] + " " + sentence(12) + "\n" + sentence(20), "\n".join([sentence(9), texts[6], sentence(9)])]
    texts += [sentence(15) + " " + item.upper() + " " + sentence(15), item, None, "", " \n ", "one"]
    junk = ["\n".join("".join(rng.choices("#$%&*", k=30)) for _ in range(6)) for _ in range(40)]
    rows = [(i, t, "en", rng.choice(["a", "b", None]), 1) for i, t in enumerate([*texts, *junk])]
    labels = [(i, int(i < len(texts)), 0) for i in range(len(rows)) if rows[i][1]]
    odd = [(7, sentence(40), "en", "a", 1), (7, rows[7][1], "en", "b", 1), (7, "", None, None, None), (None, sentence(30), "en", "a", 1), (None, None, None, None, None)]
    return rows + odd, labels, [(1, item), (2, None), (3, "")]


def test_each_stage_against_a_plain_version(spark, tmp_path):
    docs, labels, items = corpus()
    at = tables(spark, f"file://{tmp_path}", docs, labels, items)
    steps = dict(corpus_pipeline.STAGES)
    rows = lambda found: sorted((tuple(r) for r in found.collect()), key=str)
    table = lambda x: spark.createDataFrame(x, SCHEMA)

    good = rows(steps["quality classifier"](spark, spark.read.parquet(f"{at}/documents.parquet"), at))
    n_texts = len(docs) - 45
    assert sum(1 for r in good if r[0] is not None and r[0] < n_texts and r[1]) > 0.9 * n_texts and not any(r[1] and r[1][0] in "#$%&*" for r in good)
    assert all(good.count(r) <= docs.count(r) for r in good)

    lined = rows(steps["line dedup"](spark, table(docs), at))
    kept = {(r[0], r[1]) for r in lined}
    for i, t, *_ in docs:
        if i is None or i == 7 or not t or i < 80:
            assert (i, t) in kept or i in (81, 82), i
    by_id = {r[0]: r[1] for r in lined if r[0] != 7}
    assert by_id[3].split("\n")[1:] and 80 not in by_id and 81 not in by_id and by_id[85].count("\n") == 1
    assert all(r[4] == (None if r[1] is None else len(r[1])) for r in lined)

    one = rows(steps["n-gram Jaccard join"](spark, table(docs), at))
    groups = defaultdict(list)
    own = [(k, r[1]) for k, r in enumerate(docs)]
    for k, n, root in brute(own):
        if n and docs[k][0] is not None:
            groups[root].append(docs[k])
    want = [r for r in docs if r[0] is None or not words(r[1])] + [min(g, key=lambda r: r[0]) for g in groups.values()]
    assert sorted((r[0], r[1]) for r in one if r[0] is not None and r[0] != 7) == sorted((r[0], r[1]) for r in want if r[0] is not None and r[0] != 7)
    assert sorted(str(r[1]) for r in one if r[0] == 7) == sorted({str(r[1]) for r in docs if r[0] == 7}) and sum(r[0] is None for r in one) == 2

    clean = rows(steps["benchmark decontamination"](spark, table(docs), at))
    cut = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    item = words(items[0][1], cut)
    windows = {tuple(item[k : k + 10]) for k in range(len(item) - 9)}
    hit = {i for i, t, *_ in docs if any(tuple(words(t, cut)[k : k + 10]) in windows for k in range(len(words(t, cut))))}
    assert hit == {86, 87} and 87 not in {r[0] for r in clean} and len(clean) == len(docs) - 1
    left = next(r[1] for r in clean if r[0] == 86)
    assert words(left, cut) == [w for w in words(docs[86][1], cut) if w not in item]
    assert sorted(str((r[0], r[1])) for r in clean if r[0] != 86) == sorted(str((r[0], r[1])) for r in docs if r[0] not in hit)

    mixed = steps["mixing sources"](spark, table(docs), at).collect()
    size = {str((i, len(words(t)))) for i, t, *_ in docs}
    assert len(mixed) == len(docs) and {str((r.doc_id, r.size)) for r in mixed} == size and all(r.taken <= 3 * r.size for r in mixed)


def test_the_row_that_stays_does_not_depend_on_order(spark):
    text = " ".join(f"w{k}" for k in range(30))
    docs = [(7, text, "en", s, 1) for s in "dbac"] + [(8, "some other words", "en", "b", 1)]
    stage = dict(corpus_pipeline.STAGES)["n-gram Jaccard join"]
    for given in (docs, docs[::-1]):
        got = stage(spark, spark.createDataFrame(given, SCHEMA).coalesce(1), None).collect()
        assert sorted(tuple(r) for r in got) == [(7, text, "en", "a", 1), docs[4]]


def test_run_chains_the_stages_and_takes_empty_tables(spark, tmp_path):
    docs, labels, items = corpus()
    at = tables(spark, f"file://{tmp_path}/full", docs, labels, items)
    done = corpus_pipeline.run(spark, at).collect()
    step = spark.read.parquet(f"{at}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        step = spark.createDataFrame(stage(spark, step, at).collect(), stage(spark, step, at).schema)
    assert sorted(map(str, done)) == sorted(map(str, step.collect()))
    none = tables(spark, f"file://{tmp_path}/none", [], [], [])
    assert corpus_pipeline.run(spark, none).collect() == []


def test_the_ngram_stage_gives_back_what_the_drivers_jvm_freed(spark, monkeypatch):
    given, run = [], runtime.give_back_jvm
    monkeypatch.setattr(runtime, "give_back_jvm", lambda s: given.append(run(s)))
    text = " ".join(f"w{k}" for k in range(30))
    stage = dict(corpus_pipeline.STAGES)["n-gram Jaccard join"]
    kept = stage(spark, spark.createDataFrame([(k, t, "en", "a", 1) for k, t in enumerate([text, text, text + " end", "other"])], SCHEMA), None).collect()
    assert sorted(r.doc_id for r in kept) == [0, 3] and len(given) > 5
