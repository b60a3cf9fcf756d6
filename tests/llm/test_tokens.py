import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tallybook.llm.packing import best_fit, pack
from tallybook.llm.tokenfile import Block, compress, expand, expansions, read_tokens, write_block, write_tokens
from tallybook.llm.tokens import encode_column, vocabulary
from tests.llm.conftest import messy_rows


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def ids_of(library, text, end):
    return [*library.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def test_ids_equal_the_library(library):
    random.seed(3)
    signs = list("abXY'’ \t\n\r\x0b\x1c\x85 éÉßñ×÷ÿ̈中文😀12٣½_-.,;<|>\"$€İıſΣσς\x00\x7f") + ["<|endoftext|>", "<|startoftext|>", "'s", "'LL", "é"]
    texts = ["".join(random.choice(signs) for _ in range(random.randint(0, 80))) for _ in range(1500)] + ["", None]
    got = []
    for ids, counts in encode_column(pa.array(texts), vocabulary()):
        got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_compression_round_trip_and_random_access():
    random.seed(4)
    docs = [[random.choice([5, 5, 6, 7, 70000]) for _ in range(random.randint(0, 400))] + [2] for _ in range(60)] + [[9] * 999 + [2], [2]]
    ids, starts = np.array([i for d in docs for i in d], np.uint32), np.cumsum([0] + [len(d) for d in docs])
    symbols, first, rounds, terminals = compress(ids, starts, 4)
    assert len(symbols) < 0.7 * len(ids) and rounds
    assert expand(symbols.astype(np.int64), *expansions(rounds, terminals)).tolist() == ids.tolist()
    block = Block(write_block(np.arange(len(docs)), np.zeros(len(docs), bool), ids, starts))
    assert [block.document(k).tolist() for k in (0, 17, 60, 61)] == [docs[k] for k in (0, 17, 60, 61)]
    assert (block.rule_lengths == block.length[block.terminals :]).all()
    with pytest.raises(ValueError):
        Block(b"\0" * 100)


@pytest.mark.parametrize("shard_ids", [1, 500, 1 << 20])
def test_token_files(spark, messy, library, tmp_path, shard_ids):
    write_tokens(messy, f"{tmp_path}/t", shard_ids=shard_ids)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.start, r.n_tokens, r.ids_crc32) for r in read_tokens(spark, f"{tmp_path}/t").collect())
    want = sorted((i if i is not None else -1, len(x := ids_of(library, t, 2)), crc(x)) for i, t, *_ in messy_rows())
    assert [(a, n, c) for a, _, n, c in got] == want or sorted((a, n, c) for a, _, n, c in got) == want
    by_start = sorted(got, key=lambda r: r[1])
    assert [r[0] for r in by_start] == sorted(r[0] for r in got)
    assert [r[1] for r in by_start] == np.cumsum([0] + [r[2] for r in by_start])[:-1].tolist()


def test_packing(messy, library):
    rows = pack(messy).collect()
    want = defaultdict(int)
    for i, t, *_ in messy_rows():
        ids = ids_of(library, t, 0)
        for k in range(0, len(ids), 2048):
            want[i, k // 2048, k, len(ids[k : k + 2048]), crc(ids[k : k + 2048])] += 1
    got = defaultdict(int)
    used = defaultdict(list)
    for r in rows:
        got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        used[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(used) <= -(-sum(r.length for r in rows) // 2048) + 1


@pytest.mark.parametrize("choose", ["norm", "dot"])
def test_every_constraint_holds(choose):
    lengths = np.random.default_rng(1).integers(1, 100, 500)
    bins, offsets = best_fit(lengths, (100, 5, 5000.0 * 2), (1.0, 1.0, 1.0), choose)
    for b in np.unique(bins):
        mine = lengths[bins == b]
        assert mine.sum() <= 100 and len(mine) <= 5 and (mine**2).sum() <= 10000
        assert sorted(offsets[bins == b]) == np.cumsum([0, *mine[np.argsort(offsets[bins == b])]])[:-1].tolist()


def test_no_rows(spark, nothing, tmp_path):
    assert pack(nothing).count() == 0
    write_tokens(nothing, f"{tmp_path}/t")
    assert read_tokens(spark, f"{tmp_path}/t").count() == 0
