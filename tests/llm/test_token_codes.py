"""Token files: ids of whole texts, round trip, random access, widths."""

import itertools
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sluice.llm import token_codes as T
from tests.llm.conftest import make_texts

PATH = public_tokenizers.path(T.VOCABULARY)


@pytest.fixture(scope="module")
def full():
    return Tokenizer.from_file(PATH)


def test_chunks_do_not_change_ids(full):
    r = random.Random(1)
    odd = ["a", "é", "ß", " ", "  ", "\n", "\t", " ", " ", "　", "\u0085", "'s", "don't", "12", "!?", "<|endoftext|>", "<|", "|>", "b", "÷", "中", "\x1c", "\x00", "🙂"]
    texts = [x for x in make_texts() if x is None or len(x) < 30_000] + ["".join(r.choice(odd) for _ in range(r.randint(0, 40))) for _ in range(400)]
    ids, ends = T.Encoder(PATH).encode(pa.array(texts, pa.string()))
    want = [e.ids for e in full.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in itertools.pairwise(ends.tolist())] == want


def test_widths_are_the_best():
    r = random.Random(2)
    for _ in range(30):
        ids = np.array([r.randrange(1 << r.randint(0, 9)) for _ in range(r.randint(1, 60))], np.uint32)

        def size(ws, ids=ids):
            total, shift = 0, 0
            for k, w in enumerate(ws):
                n = len(ids) if k == 0 else int((ids >> shift > 0).sum())
                total, shift = total + n * (w + (k + 1 < len(ws))), shift + w
            return total

        most = max(1, int(ids.max()).bit_length())
        every = [c for k in range(1, most + 1) for c in itertools.product(range(1, most + 1), repeat=k) if sum(c) == most] if most <= 7 else []
        found = T.widths(ids)
        assert sum(found) == most and (not every or size(found) == min(map(size, every)))


def test_file_and_random_access(tmp_path):
    r = np.random.default_rng(3)
    ids = (r.integers(0, 1 << 32, 5000, dtype=np.uint64) >> r.integers(0, 32, 5000).astype(np.uint64)).astype(np.uint32)
    starts = np.concatenate([[0], np.sort(r.integers(0, 5000, 20)), [5000]])
    T.write_file(f"file://{tmp_path}/x.dac", [None, None, *range(19)], starts, ids)
    with pyarrow.fs.LocalFileSystem().open_input_file(f"{tmp_path}/x.dac") as f:
        held = T.TokenFile(f)
        assert held.documents()[0] == [None, None, *range(19)] and held.documents()[1].tolist() == starts.tolist()
        for a, b in [(0, 5000), (0, 0), (4999, 5000), (511, 513), *sorted(map(tuple, np.sort(r.integers(0, 5001, (40, 2)), axis=1).tolist()))]:
            assert held.span(a, b).tolist() == ids[a:b].tolist()
        assert [held.token(i) for i in range(0, 5000, 7)] == ids[::7].tolist()
    open(f"{tmp_path}/y", "wb").write(b"x" * 40)
    with pyarrow.fs.LocalFileSystem().open_input_file(f"{tmp_path}/y") as f, pytest.raises(ValueError, match="token codes"):
        T.TokenFile(f)


@pytest.mark.parametrize("file_tokens", [300, T.FILE_TOKENS])
def test_round_trip(spark, docs, doc_rows, full, tmp_path, file_tokens):
    want, at = [], 0
    for i, t in sorted(((r[0], r[1] or "") for r in doc_rows), key=lambda x: (x[0] is not None, x)):
        ids = [*full.encode(t, add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, T.round_trip(docs, file_tokens=file_tokens).collect()), key=lambda r: r[1]) == want
    folder = f"file://{tmp_path}/files"
    directory = T.write(docs, folder, file_tokens=file_tokens)
    assert directory.count() == len(os.listdir(tmp_path / "files")) and (directory.count() > 10) == (file_tokens == 300)
    asked = spark.range(0, at + 50, 17).select(F.col("id").alias("position"))
    flat = [x for _, t in sorted(((r[0], r[1] or "") for r in doc_rows), key=lambda x: (x[0] is not None, x)) for x in [*full.encode(t, add_special_tokens=False).ids, 2]]
    assert dict(map(tuple, T.tokens_at(directory, folder, asked).collect())) == {i: flat[i] for i in range(0, at, 17)}


def test_no_documents(no_docs):
    assert T.round_trip(no_docs).count() == 0
