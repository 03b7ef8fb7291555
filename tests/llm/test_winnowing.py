"""Benchmark windows found in documents, against a search word by word."""

import hashlib
import random
import re

import pytest

from leafmill.llm import winnowing
from tests.llm.util import docs, with_clashes

SCHEMA = "item_id long, text string"


def plain(rows, items, window=10):
    """Every place of every window, by comparing lists of words."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    for i, text in rows:
        words, hit, found = split(text), set(), set()
        for item, own in items:
            own = split(own)
            n = min(window, len(own))
            known = {tuple(own[a : a + n]) for a in range(len(own) - n + 1)} if n else set()
            for at in range(len(words) - n + 1):
                if tuple(words[at : at + n]) in known:
                    hit |= set(range(at, at + n))
                    found |= {str(item)} - {"None"}
        out.append((i, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(spark, rows, items, clash=False, **options):
    table = docs(spark, rows)
    got = winnowing.contaminated(with_clashes(table) if clash else table, spark.createDataFrame(items, SCHEMA), **options)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("seed", [1])
def test_random_texts_of_few_words(spark, seed):
    """Few words, so that windows repeat, overlap and come near to each other; short items and ties of every kind."""
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choices(["a", "b", "Ab", "é", "x9"], k=n))
    items = [(i, text(rng.randint(0, 25))) for i in range(12)] + [(3, text(12)), (None, text(11)), (40, None), (41, "..."), (42, "one"), (43, "a b a b")]
    rows = [(i, text(rng.randint(0, 60))) for i in range(40)] + [(i % 7, f"{text(8)}, {items[i % 12][1]}. {text(5)}") for i in range(30)]
    rows += [(None, items[1][1]), (5, None), (5, ""), (5, "One"), (None, None), (50, "a " * 400), (51, items[0][1].replace(" ", "\n--\n").upper())]
    assert run(spark, rows, items, clash=True) == plain(rows, items)
    assert run(spark, rows, items, part_windows=70) == plain(rows, items)
    assert run(spark, rows, items, part_bytes=300, window=4, gram=2) == plain(rows, items, 4)


def test_every_span_of_ten_words_is_found(spark):
    """Winnowing's guarantee, at every place of an item and of a document; nine words in a row aren't enough."""
    words = [f"w{i}" for i in range(60)]
    items = [(1, " ".join(words))]
    rows = [(i, " ".join(["x"] * (i % 5) + words[i : i + 10] + ["y"] * (i % 3))) for i in range(51)] + [(100 + i, " ".join(words[i : i + 9]) + " z") for i in range(51)]
    got = run(spark, rows, items)
    assert got == plain(rows, items) and sum(r[5] for r in got) == 51


def test_odd_tables(spark):
    rows = [(1, "a b c"), (2, "İ ſ K ＡＢ ünd"), (3, "日本語 é́ 🙂 x")]
    items = [(1, "İ ſ K ＡＢ ünd"), (2, "日本語 é́ 🙂")]
    assert run(spark, rows, items) == plain(rows, items)
    assert run(spark, rows, []) == plain(rows, [])
    assert run(spark, [], items) == []
    long_text = "lorem ipsum " * 200_000 + " ".join(f"k{i}" for i in range(12))
    rows = [(1, long_text), (2, "x" * 3_000_000)]
    items = [(1, " ".join(f"k{i}" for i in range(10))), (2, "y" * 100_000), (3, "x" * 3_000_000)]
    assert run(spark, rows, items) == plain(rows, items)
    with pytest.raises(ValueError):
        winnowing.contaminated(docs(spark, rows), spark.createDataFrame(items, SCHEMA), gram=11)


def test_no_python_in_the_plan(spark, monkeypatch):
    plans = []
    keep = winnowing.materialize
    monkeypatch.setattr(winnowing, "materialize", lambda df, label: (plans.append(df._jdf.queryExecution().toString()), keep(df, label))[1])
    out = winnowing.contaminated(docs(spark, ["a b"]), spark.createDataFrame([(1, "a b")], SCHEMA))
    plans.append(out._jdf.queryExecution().toString())
    assert len(plans) == 5 and not any(w in p for p in plans for w in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))
