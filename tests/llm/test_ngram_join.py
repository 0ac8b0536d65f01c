import random
import re
from collections import defaultdict

import numpy as np
import pytest

from lodestar.llm import components, ngram_join, runtime
from lodestar.llm.ngram_join import ngram_components

SCHEMA = "doc_id long, text string, set_key string, bucket int, n int"


def brute(rows):
    sets = []
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((i, frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()))
    up = list(range(len(sets)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    inverted = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for e in s:
            inverted[e].append(k)
    common = defaultdict(int)
    for ks in inverted.values():
        for a in range(len(ks)):
            for b in range(a):
                common[ks[b], ks[a]] += 1
    for (a, b), c in common.items():
        if 100 * c >= 75 * (len(sets[a][1]) + len(sets[b][1]) - c):
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    low = {}
    for k, (i, _) in enumerate(sets):
        low[top(k)] = min(low.get(top(k), i), i)
    return sorted((i, len(s), low[top(k)]) for k, (i, s) in enumerate(sets))


def edited(rng, words, rate):
    return [rng.choice("pqrstuv") + str(rng.randrange(999)) if rng.random() < rate else w for w in words]


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force_with_groups_of_near_copies(spark, seed):
    rng = random.Random(seed)
    texts = []
    for n in (3, 5, 6, 9, 14, 30, 60, 200, 700):
        base = [f"w{rng.randrange(5000)}" for _ in range(n)]
        for k in range(14):
            texts.append(" ".join(edited(rng, base, rng.choice([0, 0.01, 0.02, 0.03, 0.05]))) if k else " ".join(base))
    shared = " ".join(f"s{k}" for k in range(40))
    texts += [shared + " " + " ".join(f"x{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    texts += ["", None, "one", "One", "a b c d", "a b c", " \t "]
    rng.shuffle(texts)
    rows = [(i, t, "x", 1, 2) for i, t in enumerate(texts)]
    got = sorted(tuple(r) for r in ngram_components(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == brute(rows)


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(1, "a b c d e f g", None, None, None)] * 2 + [(3, "a b c d e f g", None, None, None), (4, None, None, None, None), (5, "z", None, None, None)]
    got = sorted(tuple(r) for r in ngram_components(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, 3, 1), (1, 3, 1), (3, 3, 1), (4, 0, 4), (5, 1, 5)]
    null = ngram_components(spark.createDataFrame([(None, "q r s t u"), (None, None), (7, "q r s t u")], "doc_id long, text string")).collect()
    assert sorted((str(r[0]), r[1], r[2]) for r in null) == [("7", 1, 7), ("None", 0, None), ("None", 1, 7)]
    assert ngram_components(spark.createDataFrame([], SCHEMA)).collect() == []


def test_large_clusters_are_dealt_into_levels_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join.blocks_of, "__defaults__", (75, 9, 400))
    rng = random.Random(5)
    texts = []
    for n in (8, 12, 40):
        base = [f"w{rng.randrange(5000)}" for _ in range(n)]
        texts += [" ".join(edited(rng, base, rng.choice([0.01, 0.05, 0.1]))) for _ in range(40)]
    for n in range(6, 40):
        texts.append(" ".join(f"c{k}" for k in range(n)))
    rows = list(enumerate(texts))
    got = sorted(tuple(r) for r in ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows)


def test_similar_against_plain_sets():
    rng = np.random.default_rng(4)
    for m in (2, 5, 40):
        base = rng.integers(0, 2**63, 60, dtype=np.uint64)
        sets = [np.unique(np.concatenate([rng.permutation(base)[: rng.integers(30, 60)], rng.integers(0, 2**63, rng.integers(0, 9), dtype=np.uint64)])) for _ in range(m)]
        bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        for border in (0, m // 2):
            i, j = ngram_join.similar(np.concatenate(sets), bounds, 75, border)
            plain = [set(s.tolist()) for s in sets]
            want = [(a, b) for a in range(m) for b in range(a + 1, m) if 100 * len(plain[a] & plain[b]) >= 75 * len(plain[a] | plain[b]) and (not border or a < border <= b)]
            assert sorted(zip(i.tolist(), j.tolist())) == want


def test_common_shingles_change_no_link(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LEAST", 3)
    monkeypatch.setattr(ngram_join, "LOAD", 0)
    rng = random.Random(7)
    passage = [f"p{k}" for k in range(30)]
    texts = [" ".join([*passage, *(f"o{rng.randrange(9999)}" for _ in range(n))]) for n in (0, 1, 2, 3, 5, 9, 10, 11, 30) for _ in range(6)]
    texts += [" ".join(edited(rng, passage, 0.02)) for _ in range(20)]
    rows = list(enumerate(texts))
    got = sorted(tuple(r) for r in ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows)


def test_similar_sets_always_share_a_signature():
    rng = np.random.default_rng(3)
    for n in [1, 2, 3, 4, 5, 7, 10, 13, 20, 50, 120, 400]:
        for _ in range(40):
            m = int(rng.integers(max(1, -(-75 * n // 100)), n + 1))
            common = int(-(-75 * (n + m) // 175))
            if common > m:
                continue
            pool = rng.integers(0, 2**63, n + m, dtype=np.uint64)
            a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[:common], pool[n : n + m - common]]))
            sig, of = ngram_join.signatures(np.concatenate([a, b]), np.array([0, n, n + m]), 75)
            assert set(sig[of == 0].tolist()) & set(sig[of == 1].tolist())


def test_a_common_passage_makes_no_candidates(spark):
    """Texts that share a passage but are not similar are told apart before they are read again."""
    rng = random.Random(11)
    passages = [[f"p{k}_{j}" for j in range(9)] for k in range(40)]
    texts = [" ".join([*(f"x{rng.randrange(10**6)}" for _ in range(18)), *rng.choice(passages), *(f"x{rng.randrange(10**6)}" for _ in range(18))]) for _ in range(400)]
    texts += [texts[0] + " end", texts[5] + " end"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    linked = ngram_join.candidates(rows).collect()
    assert len({k for r in linked for k in (r.a, r.b)}) == 4
    assert sorted(tuple(r) for r in ngram_components(rows).collect()) == brute(list(enumerate(texts)))


def test_sketches_never_differ_in_more_than_the_sets():
    rng = np.random.default_rng(6)
    for n, m, both in [(1, 1, 0), (5, 6, 5), (63, 65, 60), (120, 140, 115), (1000, 1100, 1000), (1000, 1300, 0), (500, 500, 300)]:
        pool = rng.integers(0, 2**63, n + m - both, dtype=np.uint64)
        a, b = np.sort(pool[:n]), np.sort(pool[n - both :])
        x, y = ngram_join.sketches(np.concatenate([a, b]), np.array([0, n, n + m]))
        assert ngram_join.apart(x, y) == ngram_join.apart(y, x) <= n + m - 2 * both
        assert n < 100 or both > 0.75 * n or 7 * ngram_join.apart(x, y) > n + m


def test_meetings_are_all_pairs_or_connected(monkeypatch):
    monkeypatch.setattr(ngram_join, "PAIRED", 4)
    rng = np.random.default_rng(8)
    sigs, names = rng.integers(0, 60, 300, dtype=np.uint64), rng.integers(0, 90, 300, dtype=np.uint64)
    a, b, low, high = ngram_join.meetings(sigs, names)
    pairs, groups = set(), 0
    for s in set(sigs.tolist()):
        x = sorted(set(names[sigs == s].tolist()))
        if len(x) <= 4:
            pairs |= {(x[i], x[j]) for j in range(len(x)) for i in range(j)}
        else:
            groups += 1
            assert {(x[0], k) for k in x[1:]} <= set(zip(low.tolist(), high.tolist()))
    assert groups and sorted(zip(a.tolist(), b.tolist())) == sorted(pairs)


def test_chained_clusters_are_taken_apart_before_texts_move(spark, monkeypatch):
    """Texts of passages that many have make chains of unlike sets; a large chain's texts are not all read again."""
    monkeypatch.setattr(ngram_join, "LEAST", 3)
    monkeypatch.setattr(ngram_join, "LOAD", 0)
    monkeypatch.setattr(ngram_join.blocks_of, "__defaults__", (75, 9, 400))
    seen, within = [], ngram_join.links_within
    monkeypatch.setattr(ngram_join, "links_within", lambda clusters, *rest: seen.append(clusters.select("member").distinct().count()) or within(clusters, *rest))
    rng = random.Random(12)
    passages = [[f"p{k}_{j}" for j in range(12)] for k in range(8)]
    texts = [" ".join(w for p in rng.sample(passages, 3) for w in p) for _ in range(90)]
    texts += [texts[0] + " end", texts[5] + " end"]
    rows = list(enumerate(texts))
    got = sorted(tuple(r) for r in ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows)
    assert len(seen) == 1 and 4 <= seen[0] < len(set(texts)) // 2


def test_possible_pairs_are_those_that_sketches_leave():
    rng = np.random.default_rng(9)
    pool = rng.integers(0, 2**63, 700, dtype=np.uint64)
    sets = [np.sort(rng.permutation(pool[: n * 10 // 9 + 1])[:n]) for n in rng.integers(1, 400, 90).tolist() + [60, 64, 65, 70, 128, 129, 140]]
    sizes = np.array([len(s) for s in sets])
    drawn = ngram_join.sketches(np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)]))
    can = lambda a, b: 175 * ngram_join.apart(drawn[a], drawn[b]) <= 25 * (sizes[a] + sizes[b]) and 4 * min(sizes[a], sizes[b]) >= 3 * max(sizes[a], sizes[b])
    for side in (np.zeros(len(sets), int), rng.integers(0, 2, len(sets))):
        found = [tuple(sorted(p)) for i, j in ngram_join.possible_pairs(sizes, drawn, side, 75) for p in zip(i.tolist(), j.tolist())]
        want = [(a, b) for b in range(len(sets)) for a in range(b) if can(a, b) and (not side.any() or side[a] != side[b])]
        assert want and sorted(found) == sorted(want)


def test_the_callers_step_reads_two_cuts_and_joins_once(spark):
    """What plans and sends tasks for many joins at once made the driver's heap grow to its bound after the last cut."""
    texts = [" ".join(f"w{k + j}" for j in range(12)) for k in (0, 0, 50, 51)]
    found = ngram_join.ngram_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 2 and plan.count("Join") == 1 and "Aggregate" not in plan
    assert sorted(r.component_id for r in found.collect()) == [0, 0, 2, 2]


def test_components_deal_each_link_once_a_scan(spark, monkeypatch):
    """A round reads its links in as many tasks as they have partitions, not in twice as many."""
    links = spark.createDataFrame([(k, k + 1) for k in range(20) if k != 9] + [(30, 30), (None, 1)], "a long, b long")
    done, run = [], components.cut
    monkeypatch.setattr(components, "cut", lambda df, *past: done.append(df._jdf.queryExecution().optimizedPlan().toString()) or run(df, *past))
    got = {(r.node, r.root) for r in components.connected_components(links).collect()}
    assert got == {(k, 0 if k < 10 else 10) for k in range(20)} | {(20, 10)}
    assert len(done) > 2 and all(p.count("Union") == 1 for p in done[1:])


def test_the_driver_gives_back_what_its_jvm_freed(spark, monkeypatch):
    given, run = [], runtime.give_back_jvm
    monkeypatch.setattr(runtime, "give_back_jvm", lambda s: given.append(run(s)))
    runtime.cut(spark.range(3)).collect()
    version = int(spark._jvm.System.getProperty("java.specification.version").split(".")[0])
    assert len(given) == 1 and (given[0] or version < 17)


def test_estimates_of_size_do_not_grow_from_round_to_round(spark, monkeypatch):
    """Each round's estimate was the product of the last one's, with four times its digits, until it filled the driver."""
    sizes, run = [], components.cut

    def cut(df, *past):
        done = run(df, *past)
        sizes.append(done._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        return done

    monkeypatch.setattr(components, "cut", cut)
    got = components.connected_components(spark.createDataFrame([(k, k + 1) for k in range(12)], "a long, b long")).collect()
    assert {r.root for r in got} == {0} and len(got) == 13
    assert len(sizes) > 3 and max(sizes) < 2**64
