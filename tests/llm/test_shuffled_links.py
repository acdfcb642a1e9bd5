"""Linking near fingerprints sends no table that grows with the input through the driver."""

from itertools import combinations

from curator.llm import common, components, simhash


def test_growing_tables_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "_FEW_ROWS", -1, raising=False)
    plans = []

    def seen(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return common.materialize(df, label)

    monkeypatch.setattr(simhash, "materialize", seen)
    monkeypatch.setattr(components, "materialize", seen)
    words = [f"w{i}" for i in range(600)]
    texts = [" ".join([*words[: 40 * a], "x", *words[40 * a :]]) for a in range(12)] + ["a b", "a b", None, "c d e f g h"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bits = [simhash.fingerprint(t) for t in texts]
    first = list(range(len(bits)))
    for _ in bits:
        for i, j in combinations(range(len(bits)), 2):
            if (bits[i] ^ bits[j]).bit_count() <= 4:
                first[i] = first[j] = min(first[i], first[j])
    assert len(set(first)) < len(set(bits))
    for crowd in (256, 1):
        found = simhash.near_duplicates(docs, crowd=crowd)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        assert {r.doc_id: r.component_id for r in found.collect()} == dict(enumerate(first))
    assert len(plans) > 12 and not [p for p in plans if "Broadcast" in p]
