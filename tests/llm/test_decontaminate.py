import random
import re

from cases import edge_rows, frame, words

from curator.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_match(text, items, window=13):
    w, hit, found = plain_words(text), set(), set()
    for item_id, item in items:
        own = plain_words(item)
        k = min(window, len(own))
        grams = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if own else set()
        for i in range(len(w) - k + 1):
            if k and tuple(w[i : i + k]) in grams:
                hit.update(range(i, i + k))
                found.add("" if item_id is None else str(item_id))
    return len(w), len(hit), sorted(found)


def setting():
    rng = random.Random(9)
    items = [(i, words(rng, 40)) for i in range(6)] + [(6, "Short, item! here"), (7, None), (8, " .,! "), (6, "another 6"), (None, words(rng, 15)), (9, "é— x")]
    rows = edge_rows()
    rows += [(100 + i, f"{words(rng, 30)} {t} {words(rng, 5)}") for i, (_, t) in enumerate(items) if t]
    rows += [(200, "SHORT item; here " * 3), (201, " ".join(items[0][1].split()[:20])), (202, f"{words(rng, 5000)} {items[1][1]}")]
    return items, rows


def test_matches_brute_force_in_one_and_in_many_blocks(spark):
    items, rows = setting()
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = sorted((str(d), *plain_match(t, items)) for d, t in rows)
    assert any(w[2] for w in want)
    for block in (1 << 20, 200):
        got = dc.matches(frame(spark, rows), bench, block_bytes=block).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"]) for r in got) == want


def test_drop_and_excise(spark):
    items, rows = setting()
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = frame(spark, rows)
    bad = {d for d, t in rows if (m := plain_match(t, items))[1] and 20 * m[1] >= m[0]}
    assert 200 in bad and 202 not in bad
    for block in (1 << 20, 200):
        kept = dc.drop_contaminated(docs, bench, block_bytes=block)
        assert kept.columns == docs.columns
        assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _ in rows if d not in bad)
    cut = dc.excise(docs, bench)
    assert cut.columns == docs.columns
    for r in cut.collect():
        assert plain_match(r.text, items)[1] == 0 or r.doc_id == 200
    assert {r.doc_id: r.text for r in cut.collect()}[9] == dict(rows)[9]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert dc.matches(frame(spark, []), none).collect() == []
    assert {r.n_hit for r in dc.matches(frame(spark), none).collect()} == {0}


def test_blocks_of_the_benchmark_change_nothing_in_what_is_cut(spark):
    items = [(1, "a b c d"), (2, "c d e f"), (3, "p q"), (4, "q r")]
    rows = [(1, "x a b c d e f y"), (2, "p q r."), (3, None), (4, ""), (5, "none of it"), (1, "x a b c d e f y"), (6, "c d e f, a b c d")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = [sorted(((r.doc_id, r.text) for r in dc.excise(frame(spark, rows), bench, window=4, block_bytes=n).collect()), key=str) for n in (1 << 20, 12, 4)]
    assert found[0] == found[1] == found[2]
    assert ("1", "x  y") in {(str(d), t) for d, t in found[0]} and (2, ".") in found[0] and (6, "") in found[0] and len(found[0]) == len(rows)
