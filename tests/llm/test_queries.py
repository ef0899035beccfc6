"""The opN_ queries and the pipeline on a small table of odd and plain rows, every contract column against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pagewright.llm import gru
from pagewright.llm import queries as Q
from pagewright.llm.shared import small_batches
from tokenizers import Tokenizer

from .test_dedup_and_shards import brute

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHING = ("rid", "_rid", "_taken", "taken", "_toxicity", "toxicity", "_scored", "row", "start", "length", "ids", "score", "shard", "digest", "path", "mark")


@pytest.fixture(scope="module")
def folder(spark, odd, small, labels, tmp_path_factory):
    """A folder of tables: ids are distinct, so that what a row should give is known by its id."""
    own = small.select("doc_id", "text", "lang", "source", "n_chars").collect()
    extra = [(10_001, "12 !! 7", "en", "src0", 7), (10_002, None, None, None, None), (10_003, "a <|endoftext|> b", "en", "src1", 17), (10_004, "", "de", "src1", 0)]
    extra += [(r.doc_id + 20_000, r.text, r.lang, r.source, r.n_chars) for r in odd.collect() if r.doc_id and r.doc_id > 2]
    rows = [tuple(r) for r in own] + extra
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in CLASHING:
        df = df.withColumn(c, df.doc_id.cast("string"))
    path = str(tmp_path_factory.mktemp("tables"))
    df.repartition(3).write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture(scope="module")
def empty(spark, folder, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{path}/{t}.parquet")
    return path


@pytest.fixture(scope="module")
def docs(spark, folder):
    return {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


def crc(i, m):
    return zlib.crc32(str(i).encode()) % m


def ids_of(name, end):
    encode = Tokenizer.from_file(public_tokenizers.path(name)).encode
    return lambda text: np.array([*encode(text or "", add_special_tokens=False).ids, end], "<u4")


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_empty_tables(spark, empty, name):
    assert Q.QUERIES[name](spark, empty).count() == 0


def test_mixing(spark, folder, docs):
    rows = Q.op1_mixing(spark, folder).collect()
    size = {i: len(WORD.findall(r.text or "")) for i, r in docs.items()}
    held = Counter()
    for i, r in docs.items():
        held[r.source] += size[i]
    names = sorted(held, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    target, free, left = dict.fromkeys(names, 0.0), {s for s in names if held[s]}, float(sum(held.values()))
    while free:
        per = left / sum(weight[s] for s in free)
        over = {s for s in free if per * weight[s] > 3 * held[s]}
        for s in over or free:
            target[s] = 3.0 * held[s] if over else per * weight[s]
        left -= sum(target[s] for s in over)
        free = free - over if over else set()
    taken = Counter()
    assert len(rows) == len(docs)
    for r in rows:
        s = docs[r.doc_id].source
        assert (r.size, r.source_size) == (size[r.doc_id], held[s]) and r.target == pytest.approx(target[s]) and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)


def test_token_files(spark, folder, docs):
    of, at = ids_of("byte_bpe_50k.json", 0), 0
    rows = {r.doc_id: r for r in Q.op2_token_files(spark, folder).collect()}
    assert rows.keys() == docs.keys()
    for i in sorted(docs):
        want = of(docs[i].text)
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (at, len(want), zlib.crc32(want.tobytes()))
        at += len(want)


def test_packing(spark, folder, docs):
    of = ids_of("word_bpe_49k.json", 2)
    want = {i: of(r.text) for i, r in docs.items()}
    covered, sequences = {i: np.zeros(len(x), int) for i, x in want.items()}, defaultdict(list)
    for r in Q.op3_packing(spark, folder).collect():
        x = want[r.doc_id]
        assert r.doc_tokens == len(x) and r.length > 0 and r.ids_crc32 == zlib.crc32(x[r.start : r.start + r.length].tobytes())
        covered[r.doc_id][r.start : r.start + r.length] += 1
        sequences[r.sequence_id].append(r)
    assert all((c == 1).all() for c in covered.values())
    padded = 0
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096
        padded += 0 if at & (at - 1) == 0 else 4096 - at
    assert padded <= 0.05 * sum(map(len, want.values()))


def test_language_and_toxicity_columns(spark, folder, docs):
    known = {r.lang for r in docs.values() if r.lang}
    rows = Q.op4_language_id(spark, folder).collect()
    assert {r.doc_id for r in rows} == docs.keys() and len(rows) == len(docs)
    for r in rows:
        text = docs[r.doc_id].text or ""
        assert r.held_out == (crc(r.doc_id, 4) == 2) and 0 <= r.score <= 1
        assert r.lang_pred in known if any(c.isalpha() for c in text) else r.lang_pred == "und"
    rows = Q.op7_toxicity(spark, folder).collect()
    assert {r.doc_id for r in rows} == docs.keys() and len(rows) == len(docs)
    assert all(r.held_out == (crc(r.doc_id, 4) == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_near_join_columns(spark, folder, docs):
    order = sorted(docs)
    links, classes = brute([docs[i] for i in order])
    rows = {r.doc_id: r for r in Q.op5_near_join(spark, folder).collect()}
    assert [rows[i].n_links for i in order] == links and len({r.class_id for r in rows.values()}) == classes


def test_exact_dedup_columns(spark, folder, docs):
    of = {i: hashlib.sha256((r.text or "").encode().lower()).hexdigest() for i, r in docs.items()}
    groups = defaultdict(list)
    for i, h in of.items():
        groups[h].append(i)
    for r in Q.op8_exact_dedup(spark, folder).collect():
        own = groups[of[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(own), len(own), r.doc_id == max(own), of[r.doc_id])


def test_fingerprint_columns(spark, folder, docs):
    order, rows = sorted(docs), {r.doc_id: r for r in Q.op9_fingerprints(spark, folder).collect()}
    texts = [docs[i].text or "" for i in order]
    for k, i in enumerate(order):
        t, following = texts[k], texts[(k + 1) % len(order)]
        cut = len(t) // 4
        edited, r = t[: len(t) - cut] + following[:cut], rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint == r.edited_fingerprint) == (t == edited) and (r.near_edited == 1) == (t == edited) and (r.near_next == 1) == (t == following)
        assert r.near_edited >= 2 * (len(t) - cut) / max(1, len(t) + len(edited)) - 1e-9
    assert len({r.fingerprint for r in rows.values()}) == len(set(texts))


def test_shard_columns(spark, folder, docs):
    rows, loads, slots = Q.op10_sharding(spark, folder).collect(), Counter(), defaultdict(list)
    for r in rows:
        data = (docs[r.doc_id].text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "bytes", None) and 0 <= r.shard < 40
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert len(rows) == len(docs) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(loads.values()) <= sum(loads.values()) / 40 + max(r.size for r in rows)


def test_network_step_by_step():
    """Scores of a text by plain loops over the same parameters, and chances that add up to one."""
    p = {k: v.astype(float) for k, v in gru.started(np.arange(1, 1024)[::-1].astype(float), np.ones(gru.FORMS), 5).items()}
    text, h, total = [3, 900, gru.HEAD + 5, gru.RARE, 0], np.zeros(gru.HIDDEN), []
    n, last = gru.HIDDEN, gru.START
    for symbol in text:
        a, u = p["gates"][last], h @ p["state"]
        z, r = (1 / (1 + np.exp(-(a[k : k + n] + u[k : k + n]))) for k in (0, n))
        h = (1 - z) * np.tanh(a[2 * n :] + r * u[2 * n :]) + z * h
        x = h @ p["to_class"] + p["class_bias"]
        log_class = x - np.log(np.exp(x).sum())
        everything = 0.0
        for s in range(gru.RARE + 1):
            c = s // gru.IN_CLASS if s < gru.HEAD else s - gru.HEAD + gru.HEAD_CLASSES
            chance = log_class[c]
            if s < gru.HEAD:
                x = h @ p["to_word"][c] + p["word_bias"][c]
                chance += x[s % gru.IN_CLASS] - np.log(np.exp(x).sum())
            everything += np.exp(chance)
            if s == symbol:
                total.append(chance)
        assert everything == pytest.approx(1)
        last = symbol
    assert gru.score(p, np.array(text), np.array([0, 5])) == pytest.approx(total, abs=1e-4)


def test_pipeline_stage_by_stage(spark, folder, docs, tmp_path):
    read, before, held = f"{folder}/documents.parquet", None, []
    for name, step in corpus_pipeline.STAGES:
        df = spark.read.parquet(read)
        columns, before = df.columns, df.collect()
        step(spark, df, folder).write.parquet(read := f"{tmp_path}/{name}")
        rows = spark.read.parquet(read).collect()
        held.append(len(rows))
        if name != "packing":
            assert spark.read.parquet(read).columns == columns
        texts = Counter((r.text or "").encode().lower() for r in before)
        if name == "toxicity":
            bad = {r.doc_id for r in Q.op7_toxicity(spark, folder).collect() if r.predicted}
            assert {r.doc_id for r in rows} == docs.keys() - bad
        elif name == "exact_dedup":
            best = {}
            for r in before:
                k = (r.text or "").encode().lower()
                best[k] = max(best.get(k, -1), r.doc_id)
            assert sorted(r.doc_id for r in rows) == sorted(best.values()) and len(rows) == len(texts)
        elif name == "near_join":
            assert len(rows) == brute(before)[1] and {r.doc_id for r in rows} <= {r.doc_id for r in before}
        elif name == "mixing":
            words = lambda some: sum(len(WORD.findall(r.text or "")) for r in some)
            assert words(rows) == pytest.approx(words(before), abs=20) and all(r.n_chars == len(r.text) for r in rows)
        else:
            of = ids_of("word_bpe_49k.json", 2)
            assert sum(r.length for r in rows) == sum(len(of(r.text)) for r in before)
    whole = corpus_pipeline.run(spark, folder)
    assert whole.count() == held[-1] and whole.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_stages_get_small_batches(spark, folder):
    """Of 3,000 texts of 8 KB, whichever stage has been called, no batch of over 4 MB goes to Python; a smaller limit stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        for step in (s for _, s in corpus_pipeline.STAGES):
            spark.conf.set(name, "64m")
            step(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
            long = spark.range(0, 3000, 1, 1).selectExpr("id", "repeat('abcdefg ', 1000) AS text")
            sizes = long.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches), "n long").collect()
            assert 24_000_000 <= sum(r.n for r in sizes) and max(r.n for r in sizes) <= 4_100_000
        spark.conf.set(name, "1m")
        small_batches(spark)
        assert spark.conf.get(name) == "1m"
    finally:
        spark.conf.set(name, before)


def test_pipeline_of_empty_tables(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0
