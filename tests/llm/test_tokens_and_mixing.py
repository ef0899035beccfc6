import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pagewright.llm.mixing import joined_runs, mix, mixed_documents, permuted, taken_texts, taken_words, targets
from pagewright.llm.packing import cuts, pack
from pagewright.llm.shared import slices
from pagewright.llm.tokenfiles import EliasFano, elias_fano, read_token_files, token_folder, write_token_files
from pagewright.llm.tokens import Encoder
from tokenizers import Tokenizer

BYTES, WORDS = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def plain(path):
    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoder_equals_the_library(path, small):
    texts = ["", " ", "a  b", "\n\nx y", "I'll  ΣΑΣ it's", "<|endoftext|> a", "a <|endoftext|> b", "x<|STARTOFTEXT|>  y", "<|startoftext|>", "< |endoftext|>", "x y", "é̂ ﬁ ", "1234 12.5!!", " lead", "trail ", "tab\tx", None]
    texts += [r.text for r in small.limit(40).collect()]
    ids, offsets = Encoder(path).encode(pa.array(texts, pa.string()))
    want = plain(path)
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == want(t), repr(t)


def test_elias_fano_round_trip():
    rng = np.random.default_rng(1)
    for values in ([], [0], [5, 5, 5], np.cumsum(rng.integers(0, 9000, 3000)), np.arange(1000)):
        values = np.asarray(values, np.uint64)
        e = EliasFano(elias_fano(values))
        assert e.all().tolist() == values.tolist() and [e.select(i) for i in range(len(values))] == values.tolist()


def test_token_files_round_trip(spark, odd, none):
    want = plain(BYTES)
    rows = read_token_files(write_token_files(odd, BYTES, token_folder(spark), 0, files=3)).collect()
    assert Counter(np.frombuffer(r.ids, "<u4").tobytes() for r in rows) == Counter(np.array([*want(r.text), 0], "<u4").tobytes() for r in odd.collect())
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at and r.n_tokens * 4 == len(r.ids)
        at += r.n_tokens
    assert read_token_files(write_token_files(none, BYTES, token_folder(spark))).count() == 0


def test_packing_covers_every_token(odd, none):
    want = plain(WORDS)
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in pack(odd, WORDS, carry=("doc_id", "text")).collect():
        docs[r.doc_id, r.text].append(r)
        sequences[r.sequence_id].append(r)
    for (_, text), pieces in docs.items():
        copies, ids = Counter(p.start for p in pieces)[0], [*want(text), 2]
        covered = np.zeros(len(ids), int)  # a repeated row is a row of its own, cut in its own way
        for p in pieces:
            assert np.frombuffer(p.ids, "<u4").tolist() == ids[p.start : p.start + p.length] and p.doc_tokens == len(ids)
            covered[p.start : p.start + p.length] += 1
        assert set(covered.tolist()) == {copies}
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and zlib.crc32(bytes(p.ids)) is not None
            at += p.length
        assert at <= 4096
    assert pack(none, WORDS).count() == 0


def test_cuts_add_up():
    for n in (1, 2, 15, 16, 17, 1000, 2049, 4095, 4096, 4097, 100_001):
        assert sum(m for _, m in cuts(n, 4096, 256, 1 / 32)) == n


def test_targets_and_permutations():
    assert targets([0, 10, 100], [1, 2, 3]) == [0.0, 30.0, 80.0]
    for n in (1, 2, 5, 97, 1000):
        there = permuted(np.arange(n), np.array(n), np.array(7))
        assert sorted(there.tolist()) == list(range(n))
        assert permuted(there, np.array(n), np.array(7), back=True).tolist() == list(range(n))


def test_mixture_meets_its_targets(odd, small, none):
    for df in (odd, small):
        rows = taken_words(*mix(df)).collect()
        taken, goal = Counter(), {}
        for r in rows:
            assert 0 <= r.taken <= 3 * r.size
            taken[r.source_size, r.target] += r.taken
            goal[r.source_size, r.target] = r.target
        assert len(rows) == df.count() and sum(r.size for r in rows) == pytest.approx(sum(taken.values()), abs=len(taken))
        assert sorted(map(str, rows)) == sorted(map(str, taken_words(*mix(df)).collect()))
    assert taken_words(*mix(none)).count() == 0


def test_mixed_documents_hold_the_words_taken(odd, none):
    taken = sum(r.taken for r in taken_words(*mix(odd)).collect())
    out = mixed_documents(odd)
    assert out.columns == odd.columns and sum(len((r.text or "").encode().split()) for r in out.collect()) == taken
    assert mixed_documents(none).count() == 0
    assert taken_texts(" a b  c ", [(0, 3), (1, 3)]) == [" a b  c ", "b  c"] and joined_runs([(5, 2), (0, 5), (9, 1)]) == [(0, 7), (9, 10)]


def test_slices_hold_bounded_texts_and_all_rows():
    texts = ["a" * 10, None, "b" * 300, "", "c" * 50, "d" * 50, "é" * 20]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["n", "text"])
    found = [p.column(1).to_pylist() for p in slices(batch, 1, 100)]
    assert [t for p in found for t in p] == texts and len(found) == 4
    assert all(len(p) == 1 or sum(len((t or "").encode()) for t in p) <= 100 for p in found)
    assert not list(slices(batch.slice(0, 0), 1, 100)) and next(slices(batch.slice(2, 2), 1, 100)).column(0).to_pylist() == [2]
