import hashlib
import math
import os
import random
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestar.llm import decontaminate, embedding_dedup, language_model, line_dedup, mixing, quality, toxicity, url_filter
from lodestar.llm.components import connected_components

#: extra columns, some named like what operators add
DOCS = "doc_id long, text string, source string, lang string, n_words int, score double, runs string"


def docs(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, sources[i] if sources else "s", "en", 7, 0.5, "r") for i, t in enumerate(texts)], DOCS)


ODD = [None, "", " \t\n ", "x", "\n\n\n", "é" * 50, "a " * 20_000, "word\x00word", "same text here", "same text here"]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(None, 1), (5, 5)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    up = {x: x for e in links for x in e if x is not None}
    for _ in range(100):
        for a, b in links:
            if a is not None:
                up[a] = up[b] = min(up[a], up[b])
    nodes = {x for a, b in links if a is not None and a != b for x in (a, b)}
    assert got == {x: up[x] for x in nodes}


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(3)
    pool = [f"w{k}" for k in range(300)]
    texts, rows = [], []
    for i in range(400):
        good, toxic = rng.random() < 0.6, rng.random() < 0.25
        lines = [[rng.choice(pool) for _ in range(rng.randrange(3, 15))] for _ in range(rng.randrange(1, 6))]
        if not good:
            lines = [[w + rng.choice(["***", "&&&", "###"]) for w in line] for line in lines]
        if toxic:
            lines[0][0:0] = ["badword", "awful"]
        texts.append("\n".join(" ".join(line) for line in lines))
        rows.append((i, int(good), int(toxic)))
    return docs(spark, texts), spark.createDataFrame([*rows, (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int"), rows


@pytest.mark.parametrize("fit,label,folds,held", [(quality.quality, 1, 5, 0), (toxicity.toxicity, 2, 4, 2)])
def test_classifiers_on_held_out_rows(labelled, fit, label, folds, held):
    table, labels, rows = labelled
    got = {r.doc_id: r for r in fit(table, labels).collect()}
    assert len(got) == 400
    out = [r for r in rows if zlib.crc32(str(r[0]).encode()) % folds == held]
    assert [got[r[0]].held_out for r in rows] == [r in out for r in rows]
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in got.values())
    assert np.mean([got[r[0]].predicted == r[label] for r in out]) > 0.9


@pytest.mark.parametrize("fit", [quality.quality, toxicity.toxicity])
def test_classifiers_take_any_text(spark, labelled, fit):
    _, labels, _ = labelled
    got = fit(docs(spark, ODD), labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert fit(docs(spark, []), labels.limit(0)).collect() == []


def test_marginals_against_all_paths():
    rng = np.random.default_rng(1)
    emit, move, first = rng.normal(size=7), rng.normal(size=(2, 2)), np.array([0, 3, 4, 7])
    p, _, _ = quality.marginals(emit, move, first)
    for a, b in zip(first, first[1:]):
        n = b - a
        total, good = 0.0, np.zeros(n)
        for path in range(2**n):
            y = [(path >> k) & 1 for k in range(n)]
            w = math.exp(sum(emit[a + k] * y[k] for k in range(n)) + sum(move[y[k], y[k + 1]] for k in range(n - 1)))
            total += w
            good += w * np.array(y)
        assert np.allclose(p[a:b], good / total)


def test_maximal_segments_against_their_definition():
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randrange(1, 14)
        at = sorted(rng.sample(range(n), rng.randrange(1, n + 1)))
        scores = [rng.choice([0.5, 1.0, 2.0]) for _ in at]
        line = [-0.75] * n
        for p, s in zip(at, scores):
            line[p] = s

        def split(lo, hi):
            best = max(((sum(line[a:b]), -(b - a), -a) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0, 0, 0))
            if best[0] <= 0:
                return []
            a = -best[2]
            b = a - best[1]
            return [*split(lo, a), (a, b - 1, round(best[0], 6)), *split(b, hi)]

        got = [(a, b, round(s, 6)) for s, a, b in toxicity.maximal_segments(np.array(at), np.array(scores), 0.75)]
        want = split(0, n)
        assert sum(s for *_, s in got) == pytest.approx(sum(s for *_, s in want)) and max(s for *_, s in got) == max(s for *_, s in want)
        assert all(line[a] > 0 and line[b] > 0 and sum(line[a : b + 1]) == pytest.approx(s) for a, b, s in got)
        assert all(x[1] < y[0] for x, y in zip(got, got[1:]))


def test_mixing(spark):
    rng = random.Random(1)
    texts = [" ".join("w" for _ in range(rng.randrange(0, 40))) for _ in range(200)] + [None, ""]
    names = [rng.choice(["b", "a", "c", "c", "c", None]) for _ in texts]
    got = mixing.mix_sources(docs(spark, texts, names)).collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        k = names[r.doc_id]
        assert r.size == len(words(texts[r.doc_id])) and r.taken <= 3 * r.size
        sizes[k] += r.size
        taken[k] += r.taken
        target[k] = r.target
    assert all(abs(taken[k] - target[k]) <= 1 and target[k] <= 3 * sizes[k] + 1e-9 for k in sizes)
    assert sum(target.values()) == pytest.approx(sum(sizes.values()))
    assert sorted(map(str, mixing.mix_sources(docs(spark, texts, names)).collect())) == sorted(map(str, got))
    assert mixing.mix_sources(docs(spark, [])).collect() == []


def test_urls(spark):
    urls = {
        "http://Blog.Example.COM/en/1?x": ("blog.example.com", "/en/1", "example.com/en/", "block"),
        "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "ftp://a.b.com/x#y": ("a.b.com", "/x", "com/", "allow"),
        "http://x.net/es/1": ("x.net", "/es/1", "net/es/", "block"),
        "http://notcom/x": ("notcom", "/x", None, "allow"),
        "http://x.com?/en/": ("x.com", "", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "a://b://c/d": ("b:", "//c/d", None, "allow"),
    }
    rows = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(rows).collect()}
    assert got == dict(enumerate(urls.values()))
    bad = [(i, f"http://spam.net/es/{i}", "h") for i in range(50)] + [(99, "http://spam.net/de/1", "h")] + [(100 + i, f"http://z{i}.com/", "h") for i in range(50)]
    found = {r.page_id: r.verdict for r in url_filter.filter_urls(spark.createDataFrame(bad, "page_id long, url string, host string")).collect()}
    assert found[99] == "block"
    assert url_filter.filter_urls(rows.limit(0)).collect() == []
    long = spark.createDataFrame([(1, "x" * 1_000_000 + "://A.com/" + "y" * 1_000_000), (2, "://" * 300_000), (3, "a" * 1_000_000)], "page_id long, url string")
    got = {r.page_id: r for r in url_filter.filter_urls(long).collect()}
    assert (got[1].host, len(got[1].path), got[2].host, got[2].path[:5], got[3].host) == ("a.com", 1_000_001, ":", "//://", "")


@pytest.mark.parametrize("most", [10**6, 5])
def test_decontamination(spark, most):
    rng = random.Random(7)
    w = [f"t{k}" for k in range(6)]
    items = [" ".join(rng.choice(w) for _ in range(n)) for n in (3, 10, 12, 25, 1)] + ["", None, "T1 t2, t3!"]
    texts = [" ".join(rng.choice([*w, "zz", "Q,"]) for _ in range(rng.randrange(0, 60))) for _ in range(25)] + [f"x {items[3]} y {items[2].upper()}", *ODD]
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bench = spark.createDataFrame([(i, t, "u") for i, t in enumerate(items)] + [(None, "t1 t2", "u")], "item_id long, text string, runs string")
    found = decontaminate.contamination(docs(spark, texts), bench, block_windows=most)
    got = {r.doc_id: tuple(r) for r in decontaminate.report(found).collect()}
    clean = {r.doc_id: r.text for r in decontaminate.without_runs(found).collect()}
    patterns = defaultdict(set)
    for i, t in enumerate(items):
        x = cut(t)
        for k in range(max(1, len(x) - 9)) if x else []:
            patterns[tuple(x[k : k + 10])].add(i)
    for d, t in enumerate(texts):
        x, hit, ids = cut(t), set(), set()
        for p, who in patterns.items():
            for k in range(len(x) - len(p) + 1):
                if tuple(x[k : k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    ids |= who
        sha = hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
        assert got[d] == (d, len(x), len(hit), len(ids), sha, bool(hit)), d
        if t is not None:
            assert cut(clean[d]) == [v for k, v in enumerate(x) if k not in hit] or not hit or len(cut(clean[d])) <= len(x) - len(hit)
    assert decontaminate.contamination(docs(spark, []), bench).collect() == []


def test_language_model(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["the", "The", "of", f"r{rng.randrange(400)}"]) for _ in range(rng.randrange(0, 60))) for _ in range(120)] + ODD
    got = {r.doc_id: r for r in language_model.score_language(docs(spark, texts), head=20).collect()}
    tokens = {i: [*words(t), "\0END"] for i, t in enumerate(texts)}
    learn = [i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for i in learn for w in tokens[i])
    n, v = sum(c.values()), len(c)
    for i, w in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i not in learn, len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel=1e-9)
        assert math.isfinite(r.score) and r.score < 0
    assert language_model.score_language(docs(spark, [])).collect() == []


@pytest.mark.parametrize("n_head,steps", [(50, 2), (1, 3), (0, 2)])
def test_model_probabilities_sum_to_one(n_head, steps):
    rng = np.random.default_rng(2)
    tokens, counts = np.sort(rng.integers(0, 2**63, n_head, dtype=np.uint64)), rng.integers(1, 1000, n_head)
    tail = rng.integers(0, 9, 4**steps).astype(np.float32)
    model = language_model.model_of(tokens, counts, tail, steps)
    probe = np.concatenate([tokens, rng.integers(0, 2**63, 6000, dtype=np.uint64)])
    ctx = np.tile(rng.integers(0, 2**63, (3, 1), dtype=np.uint64), (1, len(probe)))
    w = np.zeros((1 << 10, 4), np.float32)
    for w[:] in (0, rng.normal(size=w.shape)):
        p, _, there = language_model.log_probability(model, w, ctx, probe)
        leaf = language_model.digits_of(probe[~there], steps)
        each, at = np.unique(leaf, return_index=True)
        assert len(each) == 4**steps and there.sum() == n_head
        assert np.exp(p[there]).sum() + np.exp(p[~there][at]).sum() == pytest.approx(1, abs=1e-4)
    w[:] = 0
    p, _, there = language_model.log_probability(model, w, ctx, probe)
    assert np.allclose(np.exp(p[:n_head]), (counts + 1) / (counts.sum() + n_head + tail.sum() + len(tail)), rtol=1e-3)


def test_updates_lower_the_loss_and_expectations_match_counts():
    rng = np.random.default_rng(3)
    names = np.sort(rng.integers(0, 2**63, 8, dtype=np.uint64))
    tokens = np.tile(rng.permutation(names), 50)
    model = language_model.model_of(names, np.full(8, 50), np.zeros(4, np.float32), 1)
    ctx = language_model.contexts(tokens, np.array([0, 400]))
    w = np.zeros((1 << 10, 4), np.float32)
    loss = []
    for _ in range(6):
        loss.append(-language_model.log_probability(model, w, ctx, tokens)[0].sum())
        seen, expected = np.zeros(w.size), np.zeros((3, len(w)))
        language_model.seen_and_expected(model, w, ctx, tokens, seen, expected)
        seen = seen.reshape(w.shape)
        last = seen.sum(axis=1) - expected.sum(axis=0)
        assert (last > -1e-6).all() and seen.sum() == 3 * sum(len(language_model.choices(model, tokens)[k]) for k in (2,))
        expected = np.vstack([expected, last]).T
        w += (0.5 * np.log((seen + 0.5) / (expected + 0.5))).astype(np.float32)
    assert all(b < a for a, b in zip(loss, loss[1:])) and loss[-1] < 0.3 * loss[0]


def test_updates_do_not_depend_on_the_partitions(spark):
    texts = [(f"a b c d{k % 7} e{k % 5}",) for k in range(200)]
    counts = language_model.token_counts(spark.createDataFrame(texts, "text string"), 2)
    tokens, c, n, v = language_model.vocabulary(counts)
    model = spark.sparkContext.broadcast(language_model.model_of(tokens, c, language_model.tail_mass(counts, tokens, 1), 1))
    w = [language_model.updated(spark.createDataFrame(texts, "text string").repartition(k), model, language_model.fresh(v)) for k in (1, 5)]
    assert (n, v) == (1200, 16) and np.allclose(*w, atol=0.02) and np.abs(w[0]).max() > 0.2


def test_tokens_outside_the_classes_follow_their_context(spark):
    texts = [f"p{k} q{k}" for k in range(1500) for _ in range(8)]
    random.Random(4).shuffle(texts)
    pairs = [(k, k + off) for k in range(0, 1400, 7) for off in (0, 5)]
    docs_in = docs(spark, [*texts, *(f"p{a} q{b}" for a, b in pairs)])
    got = {r.doc_id: r.score for r in language_model.score_language(docs_in).collect()}
    right, wrong = ([got[len(texts) + i] for i in range(e, len(pairs), 2)] for e in (0, 1))
    assert np.mean(right) > np.mean(wrong) + 1


def test_model_follows_the_vocabulary(spark):
    assert [len(language_model.fresh(v)) for v in (1000, 4_000_000)] == [1 << 14, 1 << 19]
    names = [f"t{k}" for k in range(3000)]
    counts = language_model.token_counts(docs(spark, [" ".join(names * 2)]).select("text"), 4)
    tokens, c, n, v = language_model.vocabulary(counts, 100)
    assert (len(tokens), c.tolist(), n, v) == (1, [1], 6001, 3001)
    tail = language_model.tail_mass(counts, tokens, 3)
    assert tail.sum() == 9000 and len(tail) == 64 and tail.min() > 0
    first, node, side, bias = language_model.coded(np.array([1e9, 1, 1, 5, 5, 5, 5, 5, 1e6, 1e3]))
    codes = [tuple(zip(node[a:b].tolist(), side[a:b].tolist())) for a, b in zip(first, first[1:])]
    assert len(set(codes)) == 10 and len(codes[0]) == 1 and np.allclose(np.exp(bias).sum(axis=1), 1, atol=1e-3)


def test_operators_need_no_package_on_the_workers(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))!r})
from pyspark.sql import SparkSession
from lodestar.llm import decontaminate, language_model
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").getOrCreate()
d = spark.createDataFrame([(i, "one two three " * 9) for i in range(6)], "doc_id long, text string")
b = spark.createDataFrame([(1, "two three one")], "item_id long, text string")
print("ROWS", language_model.score_language(d).count() + decontaminate.report(decontaminate.contamination(d, b)).where("contaminated").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert "ROWS 12" in done.stdout, done.stderr[-2000:]


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 24))
    x = [(b + rng.normal(size=24) * s).astype(np.float32) for b in base for s in (0, 0, 0.02, 0.05, 0.15)]
    label = [int(rng.integers(0, 3)) for _ in base for _ in range(5)]
    rows = [(i, [float(y) for y in v], k, 9) for i, (v, k) in enumerate(zip(x, label))]
    n = len(rows)
    rows += [(n, None, 1, 9), (n + 1, [0.0] * 24, 1, 9), (n + 2, [float("nan")] * 24, 1, 9), (n + 3, rows[0][1], None, 9), (n + 4, [None] * 24, 1, 9), (n + 5, [], 1, 9)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n_links int")
    got = {r.vec_id: tuple(r) for r in embedding_dedup.near_duplicates(table).collect()}
    m = np.stack(x).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = (m @ m.T >= 0.98) & (np.array(label)[:, None] == np.array(label)[None, :])
    np.fill_diagonal(near, False)
    root = np.arange(n)
    for _ in range(n):
        new = np.array([min([root[i], *root[near[i]]]) for i in range(n)])
        if (new == root).all():
            break
        root = new
    assert [got[i] for i in range(n)] == [(i, int(near[i].sum()), int(root[i]), bool(root[i] == i)) for i in range(n)]
    assert all(got[i] == (i, 0, i, True) for i in range(n, n + 6))
    assert embedding_dedup.near_duplicates(table.limit(0)).collect() == []


def test_line_dedup(spark):
    rng = random.Random(6)
    line = lambda: " ".join(f"w{rng.randrange(900)}" for _ in range(rng.randrange(4, 12)))
    base = [[line() for _ in range(8)] for _ in range(6)]
    texts = ["\n".join(b) for b in base]
    for _ in range(30):
        a, b = rng.choice(base), rng.choice(base)
        i, j = rng.randrange(8), rng.randrange(8)
        texts.append("\n".join([line(), *a[i : i + 4], line(), *b[j:]]))
    texts += [texts[0], *ODD]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    split = {i: t.split("\n") for i, t in enumerate(texts) if t is not None}
    owner, df = {}, Counter()
    for i, lines in split.items():
        for x in set(lines):
            if len(x.encode()) >= 16 and x.split():
                owner.setdefault(x, i)
                df[x] += 1
    for i, t in enumerate(texts):
        if t is None:
            assert got[i].text is None and got[i].n_lines == 0
            continue
        shared, gone = defaultdict(set), set()
        for x in set(split[i]):
            if owner.get(x, i) < i:
                shared[owner[x]].add(x)
        for o in shared:
            for _, j, n in line_dedup.patience(split[o], split[i]):
                if sum(len(x.split()) for x in split[i][j : j + n]) >= line_dedup.MIN_WORDS:
                    gone |= set(range(j, j + n))
        assert got[i].text == "\n".join(x for k, x in enumerate(split[i]) if k not in gone), i
        assert (got[i].n_lines, got[i].n_removed) == (len(split[i]), len(gone))
    assert got[36].text == "" and got[36].lang == "en"
    assert line_dedup.dedup_lines(docs(spark, [])).collect() == []


def test_line_dedup_of_a_frequent_line(spark):
    passage = " ".join(f"common{k}" for k in range(60))
    texts = ["\n".join(" ".join(f"d{i}w{j}x{k}" for k in range(60)) for j in range(4)) for i in range(300)]
    texts = [f"{t[: t.index(chr(10))]}\n{passage}{t[t.index(chr(10)) :]}" for t in texts]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    assert got[0].text == texts[0] and got[0].n_removed == 0
    for i in range(1, 300):
        assert got[i].text == texts[i].replace(passage + "\n", "") and (got[i].n_removed, got[i].partner_ids) == (1, [0])


def test_line_dedup_of_a_block_whose_lines_stand_elsewhere_first(spark):
    own = lambda i: " ".join(f"d{i}x{k}" for k in range(20))
    block = ["alpha beta gamma delta epsilon", "zeta eta theta iota kappa lambda", "twenty more words"]
    texts = [f"{own(i)}\n{x}\nown end {i}" for i, x in enumerate(block)]
    texts += ["\n".join([own(3), *block, own(4)]), "\n".join([own(5), *block[:2], own(6)]), "\n".join([own(7), *block, own(8)])]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    assert [got[i].n_removed for i in range(6)] == [0, 0, 0, 0, 2, 3]
    assert got[4].text == own(5) + "\n" + own(6) and got[5].text == own(7) + "\n" + own(8)
    assert got[4].partner_ids == [3] and got[5].partner_ids == [3]


def test_line_dedup_of_short_lines(spark):
    values = [f"v{k}" for k in range(400)]
    texts = ["\n".join(values), "\n".join(values), "\n".join(["a", "b", *values[50:350], "c"]), "\n".join(f"o{k}" for k in range(400))]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    assert [(got[i].text, got[i].n_removed) for i in range(4)] == [(texts[0], 0), ("", 400), ("a\nb\nc", 300), (texts[3], 0)]


def test_line_dedup_keys_cover_shared_blocks():
    rng = random.Random(9)
    words = np.array([rng.choice([0, 0, 1, 2, 3, 5, 9, 10, 12]) for _ in range(300)])
    first = np.array([0, 0, 40, 41, 150, 150, 300])
    starts, ends = line_dedup.short_runs(words, first, 10)
    keys = set(zip(starts.tolist(), ends.tolist(), strict=True))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        for i in range(a, b):
            for j in range(i + 1, min(b, i + 30) + 1):
                if words[i:j].sum() >= 10:
                    seen = {x for s, e in keys if i <= s and e <= j for x in range(s, e)}
                    assert {x for x in range(i, j) if words[x]} <= seen
    assert all(words[s:e].sum() >= 10 and words[s] and words[e - 1] and np.searchsorted(first, s, side="right") == np.searchsorted(first, e - 1, side="right") for s, e in keys)
    lines = np.random.default_rng(9).integers(0, 1 << 63, 12).astype(np.uint64)
    h = line_dedup.run_hashes(np.concatenate([lines, lines]), np.array([2, 14, 2, 3]), np.array([5, 17, 6, 6]))
    assert h[0] == h[1] and len(set(h.tolist())) == 3
