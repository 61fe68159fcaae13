import hashlib
import zlib

import pytest

from flowsift.llm import merkle
from flowsift.llm.merkle import BLOCK, Parent, block_levels, seal_documents
from tests.llm.conftest import SCHEMA, lowered


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = (row.doc_id, row.source, row.lang, row.n_chars, text)
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def levels_over(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + 8]) for k in range(0, len(levels[-1]), 8)])
    return levels


def climb(levels, at, value):
    proof = ""
    for nodes in levels[:-1]:
        first = at // 8 * 8
        left, right = "".join(nodes[first:at]), "".join(nodes[at + 1 : first + 8])
        proof, value, at = proof + left + right, h(left, value, right), at // 8
    return proof, value


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault((r.lang is not None, (r.lang or "").encode()), []).append((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), r))
    trees = []
    for key in sorted(groups):
        groups[key].sort(key=lambda x: x[:3])
        trees.append(levels_over([x[2] for x in groups[key]]))
    top = levels_over([t[-1][0] for t in trees])
    out = []
    for place, (key, tree) in enumerate(zip(sorted(groups), trees)):
        for at, (known, _, own, r) in enumerate(groups[key]):
            tampered = known and zlib.crc32(str(r.doc_id).encode()) % 3 == 0
            seen = leaf(r, None if r.text is None else lowered(r.text)) if tampered else own
            inner, value = climb(tree, at, seen)
            outer, root = climb(top, place, value)
            out.append((r.doc_id, own, tree[-1][0], top[-1][0], h(inner + outer), root, root == top[-1][0]))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in seal_documents(df).collect()), key=repr)


def test_documents(documents):
    rows = found(documents)
    assert rows == plain(documents.collect())
    assert 0 < sum(not r[-1] for r in rows) < len(rows) / 2


def test_odd_documents(odd_documents):
    assert found(odd_documents) == plain(odd_documents.collect())


def test_empty(empty_documents):
    assert seal_documents(empty_documents).count() == 0


@pytest.mark.parametrize("n", [1, 9, BLOCK + 1])
def test_sizes_around_a_block(spark, n):
    df = spark.createDataFrame([(i, f"Text {i}", "x", None, i) for i in range(n)] + [(5, "Alone", None, "s", 0)], SCHEMA)
    assert found(df) == plain(df.collect())


def test_several_rounds(spark):
    df = spark.createDataFrame([(i, f"Text {i}", "z" if i % 9 else "a", None, i) for i in range(2 * BLOCK)], SCHEMA).repartition(5)
    nodes = merkle.in_order(df.selectExpr("lang as _g", "doc_id as _key", "sha2(text, 256) as _digest"), ["_key"])
    assert len(merkle.grown(nodes).rounds) == 2
    assert found(df) == plain(df.collect())


def test_a_midstate_goes_on_where_it_was_kept():
    children = [h(str(i)) for i in range(8)]
    parent = Parent(children)
    assert parent.digest == h(*children)
    for slot in range(8):
        changed = children[:slot] + [h("new")] + children[slot + 1 :]
        assert parent.folded(slot, h("new")) == h(*changed)
        assert parent.siblings(slot) == ("".join(children[:slot]), "".join(children[slot + 1 :]))


def test_levels_of_a_block():
    assert block_levels([h("a")], 1) == []
    assert [len(x) for x in block_levels([h("a")], 513)] == [1, 1, 1]
    assert [len(x) for x in block_levels([h(str(i)) for i in range(9)], 9)] == [2, 1]
