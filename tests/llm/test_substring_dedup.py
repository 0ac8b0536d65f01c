import hashlib
import random
from collections import Counter

from lodestar.llm.substring_dedup import remove_repeats


def brute(rows, length):
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    seen = Counter(b[k : k + length] for _, b in texts for k in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, length, gram, schema="doc_id long, text string"):
    found = remove_repeats(spark.createDataFrame(rows, schema), length=length, gram=gram)
    return sorted((tuple(r)[:5] for r in found.collect()), key=str)


def test_brute_force(spark):
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefgh") * rng.randrange(1, 4) + rng.choice("xyzé")
    base = [" ".join(word() for _ in range(rng.randrange(5, 80))) for _ in range(12)]
    texts = list(base) + base[:3]
    for _ in range(40):
        a, b = rng.choice(base), rng.choice(base)
        i, j = rng.randrange(len(a)), rng.randrange(len(b))
        texts.append(a[i : i + rng.randrange(120)] + word() + b[j : j + rng.randrange(90)])
    texts += ["ab" * 60, "For " * 40, "a" * 75, "a" * 29, "a" * 30, "", None, base[4] + base[4]]
    rows = list(enumerate(texts))
    assert got(spark, rows, 30, 8) == brute(rows, 30)


def test_hot_keys_are_split(spark, monkeypatch):
    from lodestar.llm import substring_dedup

    monkeypatch.setattr(substring_dedup, "HOT", 200)
    rng = random.Random(8)
    passage = "".join(rng.choices("abcdef", k=24))
    texts = ["".join(rng.choices("ghijk", k=20)) + passage + "".join(rng.choices("ghijk", k=20)) for _ in range(25)]
    texts += [texts[3][5:50], texts[4][10:], "zz" + texts[3] + "yy"]
    rows = list(enumerate(texts))
    assert got(spark, rows, 30, 8) == brute(rows, 30)


def test_repeated_rows_nulls_and_empty_table(spark):
    t = "".join(random.Random(1).choices("abcdef", k=90))
    rows = [(1, t), (1, t), (1, "q" * 10), (None, t[:50]), (None, None), (2, "z" * 40)]
    assert got(spark, rows, 30, 8) == brute(rows, 30)
    wide = [(1, t, "k", 5), (2, t, None, 6)]
    assert [r[2] for r in got(spark, wide, 30, 8, "doc_id long, text string, key string, start int")] == [90, 90]
    assert got(spark, [], 30, 8) == []


def test_shared_passages_are_counted(spark):
    rng = random.Random(12)
    own = lambda n: " ".join("".join(rng.choices("abcdefghijklm", k=6)) for _ in range(n))
    passages = [own(n) for n in (44, 55, 90)]
    texts = [own(60) + " " + p + " " + own(40) for p in passages for _ in range(3)] + [own(120) for _ in range(20)] + [own(20) + own(25) * 2, None, ""]
    got = {r.doc_id: (r.n_shared, r.n_removed) for r in remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(got[i][0] > 0 for i in range(9)) and all(got[i] == (0, 0) for i in range(9, len(texts)))
    assert all(got[i][1] == 0 for i in range(6)) and all(got[i][1] >= 620 for i in range(6, 9))
    again = {r.n_shared for r in remove_repeats(spark.createDataFrame([(1, texts[0])] * 2 + [(1, texts[20])], "doc_id long, text string")).collect()}
    assert 0 in again and len(again) == 2
