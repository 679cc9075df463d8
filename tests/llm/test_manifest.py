import hashlib

import pytest
from cases import docs
from pyspark.sql import functions as F

from lodestone.llm import manifest as M

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """(root, siblings of each node, level by level)."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(at):
            run = nodes[p // 16 * 16 : p // 16 * 16 + 16]
            proofs[k].append((run[: p % 16], run[p % 16 + 1 :]))
            at[k] = p // 16
        nodes = [H(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
    return nodes[0], proofs


def brute(rows, claim):
    groups = {}
    for k, text, source in rows:
        groups.setdefault(source, []).append((k is not None, k or 0, leaf(k, source, "en", 0, text), claim(k, source, text)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    told = {s: tree([x[2] for x in sorted(groups[s])]) for s in names}
    root, tops = tree([told[s][0] for s in names])
    out = []
    for s, top in zip(names, tops, strict=True):
        subroot, proofs = told[s]
        for (has, k, own, said), proof in zip(sorted(groups[s]), proofs, strict=True):
            for before, after in proof + top:
                said = H(*before, said, *after)
            out.append((k if has else None, own, subroot, root, "".join(x for b, a in proof + top for x in b + a), said, said == root))
    return sorted(out, key=repr)


CASES = {
    "many": [(k, f"text {k % 50}", "hot" if k % 9 else f"s{k % 23}") for k in range(5300)] + [(k, "T", None) for k in range(17)] + [(9000, "", ""), (9001, None, ""), (None, "X", "s1"), (None, None, "s1"), (5, "Twice", "s2"), (5, "Twice", "s2"), (9002, "lone", "é"), (9003, "z" * 50_000, "z")],
    "one group": [(k, "A", "s") for k in range(16)],
    "one row": [(1, "A", "s")],
    "lone leaves": [(k, "A", f"s{k}") for k in range(300)],
}


@pytest.mark.parametrize("case", sorted(CASES))
def test_equals_brute_force(spark, case):
    df = docs(spark, CASES[case])
    changed = M.leaf([*(F.col(c) for c in FIELDS[:-1]), F.lower("text")])
    claim = F.when(F.col("doc_id") % 5 == 0, changed)
    want = brute(CASES[case], lambda k, s, t: leaf(k, s, "en", 0, t.lower() if t and k is not None and k % 5 == 0 else t))
    got = M.manifest(df, claim=claim).select("id", "leaf", "subroot", "root", "proof", "folded_root", "verified").collect()
    assert sorted(map(tuple, got), key=repr) == want


def test_empty_table_and_other_fields(spark):
    assert M.manifest(docs(spark, [])).count() == 0
    rows = M.manifest(docs(spark, [(1, "a", "s"), (2, "b", "s")]), fields=("text",), group_col="lang").collect()
    assert {r.id: r.leaf for r in rows} == {1: leaf("a"), 2: leaf("b")} and all(r.verified and r.root == H(leaf("a"), leaf("b")) for r in rows)


def test_a_wrong_claim_is_told(spark):
    rows = M.manifest(docs(spark, [(k, "a", "s") for k in range(20)]), claim=F.when(F.col("doc_id") == 7, F.lit("0" * 64))).collect()
    assert [r.id for r in rows if not r.verified] == [7]
