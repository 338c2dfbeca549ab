import io
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pixelspark.llm import packing, token_counts, token_files
from pixelspark.llm.common import PieceEncoder, scratch

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
ODD = [" ", "\n", "  ", "\t", " ", "\x1c", "a", "b", "Z", "é", "é", "<|endoftext|>", "<|startoftext|>", "1", "23", "!!", "'s", "don't", "Σ", "ΑΣ", "İ", "ß", "日本", "👍", "̸", "ſ", "K", "\r\n", "\x85", "　", "½", "٣", "ǅ", "가", "하"]


@pytest.fixture(scope="module")
def texts(real):
    rng = random.Random(1)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 30))) for _ in range(4000)] + real.text.tolist()


def test_pieces_give_the_ids_of_the_library(texts):
    own, library = PieceEncoder(BYTE, limit=2000), Tokenizer.from_file(BYTE)
    got = [ids.tolist() for k in range(0, len(texts), 100) for ids in own([*texts[k : k + 100]], 7)]
    assert got == [[*e.ids, 7] for e in library.encode_batch(texts, add_special_tokens=False)]


def test_merging_counts_as_the_library(texts):
    count, library = token_counts.RankMerger(WORD, cache=500), Tokenizer.from_file(WORD)
    got = [n for k in range(0, len(texts), 100) for n in count(texts[k : k + 100])]
    assert got == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 400), min_size=0, max_size=80), st.integers(2, 9), st.integers(1, 8), st.integers(1, 3))
def test_packing_loses_nothing_and_pads_nothing(sizes, bits, unit, most):
    window = 1 << bits
    packer, done = packing.SumOfSquares(window, unit, most), []
    for k, n in enumerate(sizes):
        done += packer.add(k, np.arange(n, dtype="<u4"))
    done += packer.close()
    by_doc = defaultdict(list)
    for held in done:
        total = sum(len(p[2]) for p in held)
        assert total == window or total & (total - 1) == 0
        for doc, start, ids, n in held:
            assert n == sizes[doc] and len(ids)
            by_doc[doc].append((start, ids))
    for doc, parts in by_doc.items():
        parts.sort(key=lambda p: p[0])
        assert np.concatenate([i for _, i in parts]).tolist() == list(range(sizes[doc]))
    assert len(by_doc) == len(sizes)
    assert sum(sum(map(len, (p[2] for p in held))) != window for held in done) <= bits + 1  # only the last rest, by its bits


@settings(max_examples=300, deadline=None)
@given(st.integers(2, 40), st.data())
def test_each_placement_is_the_best_one(full, data):
    """Every choice of level by trying all of them and adding up the squares."""
    packer = packing.SumOfSquares(full, 1)
    packer.counts[:] = [0, *data.draw(st.lists(st.integers(0, 4), min_size=full - 1, max_size=full - 1))]
    s = data.draw(st.integers(1, full))

    def squares(level):
        after = packer.counts.copy()
        if level:
            after[level] -= 1
        if level + s < full:
            after[level + s] += 1
        return int((after * after).sum())

    possible = [0] + [h for h in range(1, full - s + 1) if packer.counts[h]]
    found = packer.best_level(s)
    assert found in possible and squares(found) == min(map(squares, possible))
    assert found == max((h for h in possible if squares(h) == squares(found)))


@pytest.mark.parametrize("size, most", [(1100, 4), (700, 4), (980, 2), (30, 3), (2047, 8)])
def test_sizes_that_do_not_pack_keep_few_windows_open(size, most):
    packer, open_at_once, n = packing.SumOfSquares(2048, 64, most), 0, 0
    for k in range(4000):
        n += len(packer.add(k, np.zeros(size, "<u4")))
        open_at_once = max(open_at_once, int(packer.counts.sum()) + len(packer.short))
    assert open_at_once <= 16 * most and n >= 4000 * size // 2048 - 16 * most


def test_most_mixed_sequences_come_from_placements():
    rng = np.random.default_rng(3)
    sizes = np.maximum(1, rng.lognormal(6.4, 1.0, 10_000)).astype(int)
    placed = mixed = cut = 0
    for part in np.array_split(sizes, 32):
        packer = packing.SumOfSquares(2048)
        done = [held for k, n in enumerate(part) for held in packer.add(k, np.zeros(n, "<u4"))] + packer.close()
        placed += packer.placed
        mixed += sum(len(held) > 1 for held in done)
        pieces = Counter(p[0] for held in done for p in held if p[3] < 2048)
        cut += sum(n > 1 for n in pieces.values())
    assert placed >= 0.8 * mixed and cut <= 0.1 * len(sizes)


def test_packed_table(spark, awkward, nothing):
    rows = packing.pack(awkward).collect()
    library = Tokenizer.from_file(BYTE)
    want = sorted((r.doc_id if r.doc_id is not None else -1, [*library.encode(r.text or "", add_special_tokens=False).ids, 1]) for r in awkward.collect())
    groups = defaultdict(list)
    for r in rows:
        groups[r.sequence_id].append(r)
    for held in groups.values():
        held.sort(key=lambda r: r.offset)
        at = 0
        for r in held:
            assert r.offset == at
            at += r.length
        assert at <= 2048
    tokens = defaultdict(int)
    for r in rows:
        tokens[r.doc_id if r.doc_id is not None else -1] += r.length
        same = [ids for d, ids in want if d == (r.doc_id if r.doc_id is not None else -1)][0]
        assert r.doc_tokens == len(same)
        assert r.ids_crc32 == zlib.crc32(np.array(same[r.start : r.start + r.length], "<u4").tobytes())
    total = defaultdict(int)
    for d, ids in want:
        total[d] += len(ids)
    assert tokens == total
    assert packing.pack(nothing).count() == 0


ids = st.lists(st.one_of(st.integers(0, 40), st.integers(0, (1 << 32) - 1)), min_size=0, max_size=3000)


@settings(max_examples=60, deadline=None)
@given(st.lists(ids, max_size=5))
def test_file_round_trip(docs):
    f = io.BytesIO()
    writer = token_files.Writer(f)
    for k, d in enumerate(docs):
        writer.add(None if k == 0 else k, np.array(d, "<u4"))
    writer.close()
    back = list(token_files.read_file(f))
    assert [d.tolist() for _, d in back] == docs and [k for k, _ in back] == [None if k == 0 else k for k in range(len(docs))]


def test_files_table(spark, awkward, nothing):
    rows = token_files.read_ids(spark, token_files.write_ids(awkward, scratch(spark, "t"))).orderBy("start").collect()
    library = Tokenizer.from_file(BYTE)
    docs = sorted(awkward.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    at = 0
    for r, d in zip(rows, docs, strict=True):
        own = [*library.encode(d.text or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        at += len(own)
    assert token_files.read_ids(spark, token_files.write_ids(nothing, scratch(spark, "t"))).count() == 0


def test_counts_table(spark, awkward, nothing):
    library = Tokenizer.from_file(WORD)
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(awkward).collect())
    want = []
    for r in awkward.collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        want.append((r.doc_id or -1, len((r.text or "").encode()), n, n > 2048))
    assert got == sorted(want)
    assert token_counts.count_tokens(nothing).count() == 0
