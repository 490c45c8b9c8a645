"""SimHash near-dedup against brute force."""

import random
import re

import pytest
from xxhash import xxh64_intdigest

from riskcard.llm import simhash
from riskcard.llm.graph import components

SCHEMA = "doc_id long, text string, fp string, root string, component_id int, a int"


def slow_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not w:
        return 0
    s = [" ".join(w[i: i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def groups(prints, bits=4):
    vals = sorted(set(prints))
    par = {v: v for v in vals}

    def find(x):
        while par[x] != x:
            par[x] = par[par[x]]
            x = par[x]
        return x

    for i, a in enumerate(vals):
        for b in vals[i + 1:]:
            if (a ^ b).bit_count() <= bits:
                par[find(b)] = find(a)
    return {v: find(v) for v in vals}


def corpus(seed):
    rnd = random.Random(seed)
    say = lambda k: [rnd.choice(["Aa", "b", "c", "d", "é", "Éf", "x"]) for _ in range(k)]
    rows = []
    for _ in range(12):
        base = say(rnd.choice([1, 3, 5, 300, 400]))
        for _ in range(rnd.choice([1, 2, 8])):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2])):
                w[rnd.randrange(len(w))] = rnd.choice(["zz", "yy"])
            rows.append((len(rows), rnd.choice([" ", "\n\t"]).join(w)))
    n = len(rows)
    return rows + [(n, None), (n + 1, ""), (n + 2, "  \t"), (2, rows[2][1]), (2, "a text of its own"),
                   (None, rows[0][1]), (None, "only without an id"), (n + 3, " ".join(say(9000)))]


@pytest.mark.parametrize("seed,nodes", [(1, 20_000), (2, 2)])
def test_groups_match_brute_force(spark, seed, nodes):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, "f", "r", 1, 2) for d, t in rows], SCHEMA).repartition(4)
    prints = [slow_print(t) for _, t in rows]
    root, low = groups(prints), {}
    for (d, _), p in zip(rows, prints):
        if d is not None:
            low[root[p]] = min(low.get(root[p], d), d)
    want = sorted((-1 if d is None else d, p, low.get(root[p], -1)) for (d, _), p in zip(rows, prints))
    got = simhash.near_duplicates(df, tree_nodes=nodes).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.fp % 2**64,
                   -1 if r.component_id is None else r.component_id) for r in got) == want
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(low.values())
    assert len(ids) == len(set(root.values()))


def test_tree_finds_all_links_of_dense_and_sparse_sets():
    rnd = random.Random(4)
    near = {sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 5))) for _ in range(300)}
    values = list(near | {rnd.getrandbits(64) for _ in range(200)})
    want = groups(values)
    par = {v: v for v in values}
    links = list(simhash.tree_links(values, 4))
    assert len(links) < len(values)
    for a, b in links:
        par[a] = b
    classes = lambda f: sorted(map(sorted, {f(v): [w for w in values if f(w) == f(v)] for v in values}.values()))
    assert classes(lambda v: par[v]) == classes(lambda v: want[v])


def test_components_of_chains_and_stars(spark):
    rnd = random.Random(5)
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 60)]
    more = [(rnd.randint(200, 260), rnd.randint(200, 260)) for _ in range(30)]
    edges = chain + star + more
    par = {}

    def find(x):
        par.setdefault(x, x)
        while par[x] != x:
            x = par[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        par[y] = x
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for v in par if find(v) != v}


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(df).count() == 0
    assert simhash.keep_one(df).count() == 0
