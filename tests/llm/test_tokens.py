import collections
import random
import zlib

import numpy as np
import pytest
from cases import edge_rows, frame
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import fs

from curator.llm import binary, packing
from curator.llm.tokens import default_path, encoder

ENC = encoder(default_path())


def library_ids(text):
    return ENC.whole.encode(text or "", add_special_tokens=False).ids


PIECES = [" ", "  ", "\n", "\n\n", " \n", "\t", "\r\n", "a", "Foo", "don't", "'s", "12", "é", "ß", "½", "—", "!!", ".", "数", "<|endoftext|>", "\x0b", "\x1c", "\x85", "ª"]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=40), st.lists(st.sampled_from(PIECES), max_size=14).map("".join)))
def test_ids_equal_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    assert np.frombuffer(ENC.encode(text), "<u4").tolist() == library_ids(text)


def test_full_memories_are_emptied(monkeypatch):
    from curator.llm import tokens

    monkeypatch.setattr(tokens, "WORDS", 5)
    monkeypatch.setattr(tokens, "PIECES", 5)
    text = " ".join(f"word{i}, other-{i}." for i in range(50))
    assert np.frombuffer(tokens.Encoder(default_path()).encode(text), "<u4").tolist() == library_ids(text)


@pytest.mark.parametrize("width", range(1, 33))
def test_packing_of_bits(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1003).astype("<u4")
    data = binary.pack(ids, width)
    assert len(data) == -(-len(ids) * width // 8) and (binary.unpack(data, width, len(ids)) == ids).all()


def test_ids_wider_than_the_width_are_refused():
    with pytest.raises(ValueError):
        binary.pack(np.array([8]), 3)
    assert [binary.width_for(n) for n in (1, 2, 3, 256, 257, 50257)] == [1, 1, 2, 8, 9, 16]


@pytest.mark.parametrize("width", [11, 16])
def test_random_access_across_blocks(tmp_path, width):
    rng = random.Random(width)
    docs = [[rng.randrange(1 << width) for _ in range(rng.choice([0, 1, 5, 64, 65, 300]))] for _ in range(40)]
    files = fs.LocalFileSystem()
    shard = binary.ShardWriter(files.open_output_stream(f"{tmp_path}/x.bin"), width, block=64)
    for i, ids in enumerate(docs):
        shard.add(None if i == 3 else i, np.array(ids, "<u4").tobytes())
    shard.close()
    with files.open_input_file(f"{tmp_path}/x.bin") as source:
        read = binary.ShardReader(source)
        for i in rng.sample(range(40), 40):
            assert read.document(i).tolist() == docs[i]
        flat = [x for d in docs for x in d]
        assert np.concatenate([*read.parts(50, 200)]).tolist() == flat[50:250]


def test_round_trip_of_all_documents(spark):
    rows = edge_rows()
    got = binary.round_trip(frame(spark)).collect()
    want = collections.Counter((d, len(i := library_ids(t) + [2]), zlib.crc32(np.array(i, "<u4").tobytes())) for d, t in rows)
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
    assert binary.round_trip(frame(spark, [])).collect() == []


def check_packing(rows, got, capacity):
    documents = collections.Counter()
    for d, t in rows:
        ids = np.array(library_ids(t) + [2], "<u4")
        lead = len(ids) % capacity or capacity
        cuts = [0, *range(lead, len(ids) + 1, capacity)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            documents[(d, piece, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == documents
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append(r)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(sequences)


def test_every_token_is_packed_once(spark):
    rows = edge_rows()
    for group_rows in (4096, 3):
        check_packing(rows, packing.pack_documents(frame(spark), capacity=64, group_rows=group_rows).collect(), 64)
    assert packing.pack_documents(frame(spark, [])).collect() == []


def test_groups_with_gaps_exchange_pieces(spark):
    rng = random.Random(4)
    rows = [(i, " x" * rng.randrange(1, 40)) for i in range(400)]
    one = check_packing(rows, packing.pack_documents(frame(spark, rows), capacity=64, group_rows=10_000).collect(), 64)
    many = check_packing(rows, packing.pack_documents(frame(spark, rows), capacity=64, group_rows=20).collect(), 64)
    assert many <= one * 1.03 + 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_the_bound_never_exceeds_the_optimum(sizes):
    sizes, capacity = np.array(sizes, np.int64), 20

    def optimum(rest, bins):
        if not rest:
            return len(bins)
        best, tried = len(bins) + len(rest), set()
        for i, space in enumerate([*bins, capacity]):
            if space >= rest[0] and space not in tried:
                tried.add(space)
                best = min(best, optimum(rest[1:], [*bins[:i], space - rest[0], *bins[i + 1 :]]))
        return best

    least = optimum(sorted(sizes.tolist(), reverse=True), [])
    bins, offsets, free = packing.best_fit(sizes, capacity)
    assert packing.lower_bound(*np.unique(sizes, return_counts=True), capacity) <= least <= len(free)
    for b in range(len(free)):
        own = np.argsort(offsets[bins == b])
        assert (np.cumsum(sizes[bins == b][own]) - sizes[bins == b][own] == offsets[bins == b][own]).all()
        assert sizes[bins == b].sum() == capacity - free[b]


def test_the_bound_sees_more_than_the_sum():
    sizes, counts = np.array([7, 6]), np.array([3, 2])
    assert packing.lower_bound(sizes, counts, 12) == 4 and -(-int((sizes * counts).sum()) // 12) == 3


def test_no_round_packs_a_larger_group(spark, monkeypatch):
    rng, seen, pack_groups = np.random.default_rng(5), [], packing._pack_groups

    def watched(pieces, groups, stage, capacity):
        seen.append((pieces.count(), groups))
        return pack_groups(pieces, groups, stage, capacity)

    monkeypatch.setattr(packing, "_pack_groups", watched)
    sizes = rng.integers(300, 421, 3000).tolist()
    pieces = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(sizes)], "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
    bins = {}
    for r in packing.pack_pieces(pieces, 1024, group_rows=60).collect():
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(map(len, bins.values())) == len(sizes)
    for own in bins.values():
        ends = [0, *np.cumsum([n for _, n in sorted(own)]).tolist()]
        assert [at for at, _ in sorted(own)] == ends[:-1] and ends[-1] <= 1024
    assert len(seen) > 1 and all(n <= 60 * groups for n, groups in seen)
