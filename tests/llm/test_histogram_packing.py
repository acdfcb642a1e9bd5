import collections
import itertools
import random
import zlib

import numpy as np
import pytest
from cases import SMALL, edge_rows, frame
from hypothesis import given, settings
from hypothesis import strategies as st

from curator.llm import histogram_packing as packing
from curator.llm.word_tokens import WordEncoder, default_path, word_encoder

ENC = word_encoder(default_path())


def library_ids(text):
    return ENC.whole.encode(text or "", add_special_tokens=False).ids


PIECES = [" ", "  ", "\n", "\t", "\r\n", "a", "FOO", "Don't", "'S", "12", "é", "É", "ß", "½", "—", "!!", ".", "数", "<|endoftext|>", "\x0b", "\x1c", "\x85", "İ", "Σ", "é", "word,", "Word.", "x.y"]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=40), st.lists(st.sampled_from(PIECES), max_size=14).map("".join)))
def test_ids_equal_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    assert np.frombuffer(ENC.encode(text), "<u4").tolist() == library_ids(text)


def test_a_full_memory_is_emptied(monkeypatch):
    from curator.llm import word_tokens

    monkeypatch.setattr(word_tokens, "WORDS", 5)
    text = " ".join(f"word{i}, Other-{i}." for i in range(50))
    assert np.frombuffer(WordEncoder(default_path()).encode(text), "<u4").tolist() == library_ids(text)


def test_combinations_are_all_that_fill_the_window():
    got = {tuple(c) for c in packing.combinations(8, 3).T.astype(int)}
    want = set()
    for n in (1, 2, 3):
        for chosen in itertools.combinations_with_replacement(range(1, 9), n):
            if sum(chosen) == 8:
                want.add(tuple(np.bincount(chosen, minlength=9)[1:].tolist()))
    assert got == want and len(packing.combinations(8, 3).T) == len(want)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_least_squares_meet_the_optimality_conditions(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 4, (6, 15)).astype(float), rng.integers(0, 50, 6).astype(float)
    x = packing.non_negative_least_squares(a, b, rounds=500)
    descent = a.T @ (b - a @ x)
    assert (x >= 0).all() and (descent <= 1e-5).all() and np.abs(descent[x > 1e-9]).max(initial=0) <= 1e-5


def check_lengths(sizes, capacity, sequences):
    seen = collections.defaultdict(list)
    lengths = []
    for pieces in sequences:
        lengths.append(sum(n for _, _, n in pieces))
        for item, start, n in pieces:
            assert n > 0
            seen[item].append((start, n))
    assert sorted(seen) == list(range(len(sizes)))
    for item, own in seen.items():
        at = 0
        for start, n in sorted(own):
            assert start == at
            at += n
        assert at == sizes[item]
    short = [n for n in lengths if n != capacity]
    assert all(n & (n - 1) == 0 for n in short) and len(set(short)) == len(short)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 63), min_size=1, max_size=60), st.sampled_from([1, 4, 16, 64, 100]), st.integers(1, 4))
def test_every_token_lies_in_one_sequence_without_padding(sizes, classes, depth):
    check_lengths(sizes, 64, packing.pack_lengths(np.array(sizes), 64, classes, depth))


def test_the_solution_packs_most_of_a_histogram():
    rng = np.random.default_rng(3)
    columns = packing.combinations(64, 4)
    # A histogram that windows were cut from, so that all of it can be packed.
    counts = columns[:, rng.integers(0, columns.shape[1], 2000)].sum(axis=1).astype(int)
    chosen = packing.repeats(counts, 64, 4)
    used = sum(need * n for need, n in chosen)
    assert (used <= counts).all() and all((need * np.arange(1, 65)).sum() == 64 for need, _ in chosen)
    assert (used * np.arange(1, 65)).sum() > 0.95 * (counts * np.arange(1, 65)).sum()
    assert packing.repeats(np.zeros(64, int), 64, 4) == []


def check(rows, got, capacity):
    documents, placed = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        documents[r.doc_id].append(r)
        placed[r.sequence_id].append(r)
    want = collections.defaultdict(collections.Counter)
    for d, t in rows:
        want[d][tuple(library_ids(t) + [2])] += 1
    assert set(documents) == set(want)
    for d, own in documents.items():
        assert sum(r.length for r in own) == sum(len(ids) * n for ids, n in want[d].items())
        if sum(want[d].values()) == 1:
            ids, at = next(iter(want[d])), 0
            for r in sorted(own, key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(ids)
                assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
                at += r.length
    padding = 0
    for pieces in placed.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    assert padding == 0


@pytest.mark.parametrize("group_rows", [3, 4096])
def test_odd_rows(spark, group_rows):
    rows = edge_rows()
    check(rows, packing.pack_documents(frame(spark), capacity=64, group_rows=group_rows).collect(), 64)
    assert packing.pack_documents(frame(spark, [])).collect() == []
    with pytest.raises(ValueError):
        packing.pack_documents(frame(spark), capacity=100)


def test_lengths_of_whole_windows(spark):
    rng = random.Random(9)
    rows = [(i, " a" * n) for i, n in enumerate([63, 64, 127, 128, 191, 0, 1, *[rng.randrange(300) for _ in range(50)]])]
    check(rows, packing.pack_documents(frame(spark, rows), capacity=64, group_rows=20).collect(), 64)


def test_the_registered_query(spark):
    from curator.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    check(rows, QUERIES["op11_histogram_packing"](spark, SMALL).collect(), 4096)
