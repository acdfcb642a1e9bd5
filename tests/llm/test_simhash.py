import random
import re

import xxhash
from cases import edge_rows, frame

from curator.llm import simhash


def plain_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(nodes, distance=4):
    """nodes: (id, bits); the least id of each row's component."""
    group = list(range(len(nodes)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(nodes)):
        for j in range(i):
            if (nodes[i][1] ^ nodes[j][1]).bit_count() <= distance:
                a, b = top(i), top(j)
                group[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(nodes):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return [least.get(top(i)) for i in range(len(nodes))]


def test_fingerprints_and_components_match_brute_force(spark):
    rows = edge_rows()
    got = sorted((str(r.doc_id), r.bits & (2**64 - 1), str(r.component_id)) for r in simhash.near_duplicates(frame(spark)).collect())
    nodes = [(d, plain_fingerprint(t)) for d, t in rows]
    want = sorted((str(d), b, str(c)) for (d, b), c in zip(nodes, plain_components(nodes)))
    assert got == want


def test_long_texts_are_counted_in_blocks(monkeypatch):
    text = " ".join(str(i) for i in range(500))
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_links_are_exact_with_and_without_crowds(spark):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(6)]
    values = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for c in centres for _ in range(60)}
    values |= {rng.getrandbits(64) for _ in range(200)}
    values = sorted(values)
    nodes = spark.createDataFrame([(simhash._signed(v),) for v in values], "bits bigint")
    want = plain_components(list(enumerate(values)))
    for crowd in (1_000_000, 4):
        edges = simhash.links(nodes, 4, crowd)
        pairs = {(r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in edges.collect()}
        assert all((a ^ b).bit_count() <= 4 for a, b in pairs)
        group = {v: v for v in values}

        def top(v, group=group):
            while group[v] != v:
                v = group[v]
            return v

        for a, b in pairs:
            group[max(top(a), top(b))] = min(top(a), top(b))
        at = {v: i for i, v in enumerate(values)}
        assert [at[top(v)] for v in values] == want


def test_long_chains_are_one_component(spark):
    from curator.llm.components import connected

    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (5, 5)], "a bigint, b bigint")
    roots = {r.node: r.root for r in connected(edges).collect()}
    assert len({roots[i] for i in range(301)}) == 1 and roots[1000] == roots[1001] and len(roots) == 303


def test_empty_table(spark):
    assert simhash.near_duplicates(frame(spark, [])).collect() == []
