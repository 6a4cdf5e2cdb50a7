import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from promptveil.llm import decontaminate, qgrams
from promptveil.llm.queries import op5_decontaminate


def least_edits(window, text):
    """Sellers: least edits of the window against any part of the text, over the whole table of both."""
    row = np.zeros(len(text) + 1, np.int64)
    steps = np.arange(len(text) + 1)
    for i, c in enumerate(window):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[:-1] + (text != c), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min())


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        at = rng.randrange(len(out))
        what = rng.randrange(3)
        out[at:at + 1] = [] if what == 0 else [rng.choice("abcde ")] if what == 1 else [out[at], rng.choice("abcde ")]
    return "".join(out)


@pytest.mark.parametrize("seed", range(4))
def test_against_all_alignments(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(7, prose(40)), (9, prose(14)), (11, prose(5)[:22].ljust(22, "x")), (12, prose(70)), (13, "tiny piece"), (14, "")]
    index = qgrams.Index(items)
    texts = []
    for _, item in items[:5]:
        for n in (0, 1, 4, 8, 9, 14, 25):
            texts.append(prose(rng.randint(0, 60)) + " " + edited(rng, item, n) + " " + prose(rng.randint(0, 60)))
        half = len(item) // 2
        texts += [item[:half] + prose(30), prose(9) + item[half:], item.upper(), item.replace(" ", "\n"), item]
    texts += ["", prose(200), "x" * 500]
    got = {f[:3]: f for f in index.find(texts)}
    best = {}
    for f in index.find(texts):
        best[f[:3]] = min(f[5], best.get(f[:3], 99))
    folded = [qgrams.folded(t) for t in texts]
    for n, text in enumerate(folded):
        for i, points in enumerate(index.points):
            for start in index.starts[i]:
                window = points[start:start + index.window]
                if i in index.tiny:
                    want, budget = 0 if re.search(r"(?<!\w)tiny piece(?!\w)", "".join(map(chr, text.tolist()))) else 1, 0
                else:
                    want, budget = least_edits(window, text), index._budget(len(points))[0]
                assert (n, i, start) in got if want <= budget else (n, i, start) not in got, (n, i, start, want)
                if want <= budget:
                    assert best[n, i, start] == want
    for (n, i, start), f in got.items():
        part = folded[n][f[3]:f[4]]
        window = index.points[i][start:start + index.window]
        assert abs(len(part) - len(window)) <= f[5] and least_edits(window, part) <= f[5]


@pytest.mark.parametrize("size", [20, 25, 30, 38, 49, 50, 62, 75, 95, 99, 100])
def test_full_budget_of_insertions(size):
    """Edits at even distances, as many as allowed, in every direction: none may be lost between bands."""
    rng = random.Random(size)
    for case in range(60):
        item = "".join(rng.choice("abcdefgh") for _ in range(size))
        index = qgrams.Index([(1, item)])
        k = index._budget(size)[0]
        out = list(item)
        for n in range(k, 0, -1):
            at = n * size // (k + 1)
            if case % 3 == 2:
                del out[at]
            else:
                out.insert(at, rng.choice("xyz"))
        text = "".join(rng.choice("abcdefgh") for _ in range(case)) + "".join(out) + "".join(
            rng.choice("abcdefgh") for _ in range(20))
        want = least_edits(index.points[0], qgrams.folded(text))
        assert want <= k
        assert min((f[5] for f in index.find([text])), default=None) == want, (size, case)


@pytest.mark.parametrize("size", [100, 105, 110, 120, 130, 150])
def test_excerpts_from_any_place(size):
    """A part of an item, as it is or with as many edits as a window may have, is found wherever it begins."""
    rng = random.Random(size)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9)))
    item = " ".join(word() for _ in range(90))[:400]
    index = qgrams.Index([(1, item)])
    texts, tight = [], []
    for case in range(100):
        at = rng.randrange(len(item) - size + 1)
        part = item[at:at + size] if case % 2 else edited(rng, item[at:at + 100], 8)
        texts.append(" ".join(word() for _ in range(case)) + "#" + part + "#" + " ".join(word() for _ in range(20)))
    got = {f[0]: f for f in index.find(texts)}
    points = qgrams.folded(item)
    for n, text in enumerate(texts):
        if n % 2:
            assert n in got and got[n][5] <= 8
        elif n % 10 == 0:  # against every window of the item
            least = min(least_edits(points[a:a + 100], qgrams.folded(text)) for a in range(len(points) - 99))
            assert (n in got) == (least <= 8)
            tight.append(least)
    assert min(tight) >= 3


def test_items_of_few_characters():
    index = qgrams.Index([(1, "a"), (2, "x yz"), (3, "twelve chars"), (4, "the")])
    found = {f[:2] for f in index.find(["a cat and the x yz", "A", " x  yz", "x\nyz ", "so twelve  chars", "mytwelve chars", "my Twelve chars.",
                                        "twelve chars", "the"])}
    assert found == {(1, 0), (3, 1), (6, 2), (7, 2), (8, 3)}


def test_few_shared_grams():
    item = "the quick brown fox jumps over the lazy dog and runs away from the old farm where nobody lives any more"
    assert qgrams.Index([(1, item)]).find(["a quick brown fox", "lazy dog and", ""]) == []


def test_slices_of_a_long_text(monkeypatch):
    rng = random.Random(5)
    item = " ".join("".join(rng.choice("abcd") for _ in range(5)) for _ in range(30))
    text = "zz " * 400 + item + " yy" * 500 + item
    whole = qgrams.Index([(1, item)]).find([text, item])
    monkeypatch.setattr(qgrams, "_SLICE", 300)
    assert qgrams.Index([(1, item)]).find([text, item]) == whole and len(whole) > 6


def test_table_exact_copies(spark, folder, documents):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    got = {(r["doc_id"], r["item_id"]) for r in op5_decontaminate(spark, folder).collect()}
    planted = {(d, i) for d, t, _, _ in documents for i, item in items if item in t}
    assert planted and planted <= got
    assert len({d for d, _ in got}) <= len({d for d, _ in planted}) + 2


def test_odd_rows(spark, monkeypatch):
    item = "the quick brown fox jumps over the lazy dog and runs away from the old farm where nobody lives any more, they say, since spring"
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (None, "another item, of middle length, that is shorter than a window")],
                                  "item_id bigint, text string").withColumn("doc_id", F.lit(5))
    rows = [(1, None), (2, ""), (3, item), (3, item), (4, "x" * 50000 + item.upper() + "y" * 50000), (None, item[10:125]),
            (5, "nothing of the sort"), (6, "Another item, of middle\nlength, that is shorter than a window!")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("start", F.lit(1)).withColumn("item_id", F.lit(2))
    want = sorted([(3, 1), (3, 1), (4, 1), (None, 1), (6, None)], key=repr)
    for chars in (8 << 20, 60):
        monkeypatch.setattr(decontaminate, "SLICE_CHARS", chars)
        assert sorted(((r[0], r[1]) for r in decontaminate.matches(df, items).collect()), key=repr) == want
        kept = decontaminate.clean(df, items)
        assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 5]
    twice = items.union(items.where("item_id = 1")).union(items.where("item_id = 1").withColumn("item_id", F.lit(9).cast("bigint")))
    assert sorted(((r[0], r[1]) for r in decontaminate.matches(df, twice).collect()), key=repr) == sorted(
        [*want, *[(d, i) for d, i in want if i == 1], *[(d, 9) for d, i in want if i == 1]], key=repr)
    assert decontaminate.matches(df.where("false"), items).count() == 0
    assert decontaminate.matches(df, items.where("false")).count() == 0
    assert decontaminate.clean(df, items.where("false")).count() == len(rows)
