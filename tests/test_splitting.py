"""Payload files read in splits against the same files read whole."""

import json
import random

import pytest

from curator.sources.splitting import json_array_entries, xml_entries


def entries(rng, n):
    odd = ['}', '{', '"', '\\', '\\"', '],[', '}{"x":1}', 'é数', '\n', '\\\\', ',', '', ' [ ']
    value = lambda d: rng.choice([rng.randrange(9), None, True, "".join(rng.choice(odd) for _ in range(rng.randrange(6))), *([[value(d - 1) for _ in range(rng.randrange(3))], {f"k{rng.choice(odd)}{i}": value(d - 1) for i in range(rng.randrange(3))}] if d else [])])
    return [{f"a{i}": value(3) for i in range(rng.randrange(4))} for _ in range(n)]


@pytest.mark.parametrize("split", [64, 1000, 1 << 20])
@pytest.mark.usefixtures("small_ranges")
def test_json_arrays_in_splits(spark, tmp_path, split):
    rng, want = random.Random(split), {}
    for name, n in (("one", 1), ("some", 40), ("many", 400), ("none", 0)):
        found = entries(rng, n)
        mixed = [x for e in found for x in ([e] if rng.random() < 0.8 else [rng.choice([1, None, "s}", "{\"q\":[", 2.5]), e])]
        (tmp_path / f"{name}.json").write_text(json.dumps(mixed, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])))
        want[name] = found
    (tmp_path / "object.json").write_text('{"items":[{"a":1}]}')
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "cut.json").write_text('[{"a":1},{"b":')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = {}
        for r in json_array_entries(spark, str(tmp_path)).collect():
            got.setdefault(r.source_id, {})[r.place] = json.loads(r.entry)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == {k: v for k, v in {**want, "cut": [{"a": 1}]}.items() if v}


def test_xml_elements_in_splits(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<rss><channel><title>t</title>" + "".join(f"<item id='{i}'><title>n{i}</title>\n</item>" for i in range(300)) + "<items>x</items></channel></rss>")
    (tmp_path / "b.xml").write_text("<rss><channel/></rss>")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = sorted((r.source_id, r.place, r.entry) for r in xml_entries(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [("a", i, f"<item id='{i}'><title>n{i}</title>\n</item>") for i in range(300)]
