"""The manifest's trees and the repair of conversations, against plain versions and SQL on odd tables."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from leafmill.llm import conversation_repair, merkle, queries
from tests import oracle
from tests.llm.util import with_clashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TURNS = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(leaves):
    """(root, [(siblings, fold) of each leaf]) by building all levels."""
    level, paths, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for path, i in zip(paths, at, strict=True):
            first = i - i % 3
            path.append((level[first:i], level[i + 1 : first + 3]))
        at = [i // 3 for i in at]
        level = [sha("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
    return level[0], paths


def plain_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, t, la, s, n: sha("".join(map(field, (d, s, la, n, t))))
    trees = {}
    for r in rows:
        trees.setdefault(r[3], []).append(r)
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        trees[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
    subroots, lower = zip(*(plain_tree([leaf(*r) for r in trees[s]]) for s in names), strict=True)
    root, upper = plain_tree(subroots)
    out = []
    for s, sub, paths, more in zip(names, subroots, lower, upper, strict=True):
        for r, path in zip(trees[s], paths, strict=True):
            d, text = r[0], r[1]
            if text is not None and d is not None and zlib.crc32(str(d).encode()) % 2 == 0:
                text = text.replace("\n", "")
            fold = leaf(d, text, *r[2:])
            for left, right in path + more:
                fold = sha("".join(left) + fold + "".join(right))
            proof = sha("".join("".join(left) + "".join(right) for left, right in path + more))
            out.append((d, leaf(*r), sub, root, proof, fold, fold == root))
    return sorted(out, key=str)


def doc_rows(n, seed=1):
    rng = random.Random(seed)
    sources = ["big"] * 6 + ["mid", "mid", None, "é", "z", "", *[f"s{i}" for i in range(12)]]
    rows = [(i, "a\nb" * rng.randint(0, 4), rng.choice(["en", None, ""]), rng.choice(sources), rng.choice([None, 3])) for i in range(n)]
    return rows + [(None, None, None, None, None), (None, "x\ny", "en", "big", 3), (5, "x\ny", "en", "big", 3), (5, "x\ny", "en", "big", 3), (5, "x\n", "en", "big", 3), (-7, "\n" * 50_000, "en", "alone", 50_000)]


@pytest.mark.parametrize(("n", "part"), [(400, 7), (400, 1), (90, 1000), (0, 2)])
def test_manifest_is_that_of_plain_trees(spark, n, part):
    """Parts of seven rows, so that trees span many partitions and forests merge in several rounds."""
    rows = doc_rows(n)
    got = merkle.manifest(with_clashes(spark.createDataFrame(rows, DOCS)), part_rows=part)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_manifest(rows)


def test_manifest_of_little(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS)).count() == 0
    for rows in ([(1, "x\n", "en", "s", 1)], [(1, "", "en", "s", 1), (2, None, "en", None, 1)], [(9, "same", "en", "s", 4)] * 30):
        assert sorted(map(tuple, merkle.manifest(spark.createDataFrame(rows, DOCS), part_rows=4).collect()), key=str) == plain_manifest(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28, 100])
def test_forests_merge_in_any_order(n):
    leaves = [sha(str(i)) for i in range(n)]
    root, _ = plain_tree(leaves)
    rng = random.Random(n)
    for _ in range(5):
        order, parts = rng.sample(range(n), n), []
        for i in range(0, n, 4):
            part = merkle.Forest(n)
            for j in order[i : i + 4]:
                part.add(0, j, leaves[j])
            parts.append(part)
        whole = merkle.Forest(n)
        for part in rng.sample(parts, len(parts)):
            for (level, index), node in part.open.items():
                whole.add(level, index, node)
        assert list(whole.open.values()) == [root]


# conversations


def brute(turns):
    """(cost, audit, lines) by trying every keep, rerole and delete, and every needed number of inserts; turns are (role, text, gone, cut)."""
    best = None
    for kept in itertools.product("DKR", repeat=len(turns)):
        if any(k != "D" and t[2] for k, t in zip(kept, turns, strict=True)):
            continue
        for gaps in itertools.product(range(3), repeat=len(turns) + 1):
            cost, audit, lines, roles = 0, "", [], ""
            need = lambda roles: "a" if roles[-1:] == "u" else "u"
            for k, g, t in zip((*kept, ""), gaps, (*turns, None), strict=True):
                for _ in range(g):
                    role = need(roles)
                    roles, cost, audit = roles + role, cost + 3, audit + "I"
                    lines.append({"u": "user:", "a": "assistant:"}[role])
                if not k:
                    continue
                audit += k
                if k == "D":
                    cost += 4
                    continue
                role = t[0][:1] if k == "K" else need(roles)
                roles += role or "?"
                cost += (3 if k == "R" else 0) + (3 if t[3] else 0)
                lines.append((t[0] if k == "K" else {"u": "user", "a": "assistant"}[role]) + ":" + t[1])
            if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, lines)
    return best


def test_edits_are_the_cheapest_and_the_first():
    rng = random.Random(5)
    for _ in range(250):
        turns = [(rng.choice(["system", "user", "assistant", "tool", "", "u2", " "]), "t.", rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 4))]
        cost, audit, lines = brute(turns)
        part = [(t[0][:1], t[2], t[3]) for t in turns]
        found, edits, state = conversation_repair.audit(part, conversation_repair.AT_END, 0)
        assert (found, edits + "I" * conversation_repair.CLOSING[state]) == (cost, audit), turns


def turn_rows(seed=3):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "user", "assistant", "tool", "", None], ["Hi.", "Why?", "no stop", "", " \n", None, "Yes!\n", "it is. so"]
    rows = [(c, t, rng.choice(roles), f"{rng.choice(['', c])}{rng.choice(texts) or ''}") for c in range(25) for t in range(rng.randint(1, 9))]
    rows += [(100, t, rng.choice(roles[:5]), rng.choice(texts)) for t in range(150)] + [(None, t, "user", "Hm.") for t in (None, 1, 7)]
    return rows + [(200, None, "assistant", "A."), (200, None, "user", "B."), (200, 3, "user", "C"), (201, 4, None, None), (202, 9, "user", "x" * 100_000), (203, 1, "user", "dup."), (203, 1, "user", "dup.")]


@pytest.mark.parametrize("part", [1000, 9, 2])
def test_repair_matches_sql_wherever_parts_end(spark, tmp_path, part):
    """Conversations that span many partitions: the seams don't change a result."""
    df = spark.createDataFrame(turn_rows(), TURNS)
    df.coalesce(1).write.parquet(f"file://{tmp_path}/t")
    con = oracle.duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/t/*.parquet'")
    assert oracle.differences(conversation_repair.repair(with_clashes(df), part_rows=part), queries.ORACLES["op13_conversation_repair"], con) == ""


def test_repair_of_one_long_conversation(spark, tmp_path):
    """Half of all rows are one conversation's, most of them alike."""
    rng = random.Random(8)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice(["Same.", "Same.", f"{t}.", f"{t}"])) for t in range(400)]
    df = spark.createDataFrame(rows + [(c, 0, "user", "Hi.") for c in range(2, 100)], TURNS)
    df.coalesce(1).write.parquet(f"file://{tmp_path}/t")
    con = oracle.duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/t/*.parquet'")
    assert oracle.differences(conversation_repair.repair(df, part_rows=16), queries.ORACLES["op13_conversation_repair"], con) == ""
    assert conversation_repair.repair(spark.createDataFrame([], TURNS)).count() == 0
