"""The pipeline stage by stage on a small table, and the registered digests on the smallest test data."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from cattedra.llm import toxicity
from cattedra.llm.queries import QUERIES
from tests.llm import plain

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.write_shared(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns
        sizes.append(docs.count())
        if name == "simhash_near_dedup":
            prints = {r.doc_id: plain.simhash(r.text) for r in docs.collect()}
            assert len(set(plain.components(prints).values())) == len(prints) == sizes[-1]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(last) == sizes[-1] and sizes[0] >= sizes[1] == sizes[2] >= sizes[3]
    taken = {}
    for r in last:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + 1
    assert max(taken.values()) <= 2


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_token_digests(spark):
    documents = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    word = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in QUERIES["op1_bpe"](spark, SF).collect():
        ids = word.encode(documents[r.doc_id] or "", add_special_tokens=False).ids
        text = word.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    byte = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    at = 0
    for r in QUERIES["op8_token_files"](spark, SF).orderBy("doc_id").collect():
        ids = np.array([*byte.encode(documents[r.doc_id] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_recall_on_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    want, hits = plain.nearest(rows, lambda v: v), 0
    for r in QUERIES["op4_ann"](spark, "/root/testdata/sf0.01").collect():
        hits += r.vec_id in {i for i, _ in want[r.query_id]}
    assert hits / (20 * len(want)) >= 0.9


def test_held_out_documents_score_above_the_base(spark):
    got = [r for r in QUERIES["op10_katz"](spark, SF).collect() if r.held_out]
    assert got and sum(r.score for r in got) > sum(r.base_score for r in got)


def test_run_against_plain_stages(spark, monkeypatch):
    kept, write = {}, corpus_pipeline.write_shared
    monkeypatch.setattr(corpus_pipeline, "write_shared", lambda df, name: kept.setdefault(name, write(df, name)))
    last = corpus_pipeline.run(spark, SF).collect()
    source = spark.read.parquet(f"{SF}/documents.parquet")
    at = {name: kept[f"pipeline-{name}"].collect() for name, _ in corpus_pipeline.STAGES[:-1]}
    docs = source.collect()

    scores = toxicity.score(source, toxicity.fit(source, spark.read.parquet(f"{SF}/labels.parquet"))).collect()
    toxic = {r.doc_id for r in scores if r.score >= 0.7}
    assert 0 < len(toxic) < len(docs)
    want = [r for r in docs if r.doc_id not in toxic]
    assert Counter(at["toxicity"]) == Counter(want)

    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(plain.LOW)
    found = Counter(k for r in want for k in {key(x) for x in (r.text or "").split("\n")} if k)
    assert max(found.values()) >= 10
    left = {r.doc_id: "\n".join(x for x in (r.text or "").split("\n") if found[key(x)] < 10) for r in want}
    assert {r.doc_id: r.text for r in at["line_dedup"]} == left and len(at["line_dedup"]) == len(left)
    assert all(r.n_chars == len(r.text) for r in at["line_dedup"])

    roots = set(plain.components({i: plain.simhash(t) for i, t in left.items()}).values())
    assert len(roots) < len(left)
    assert Counter(at["simhash_near_dedup"]) == Counter(r for r in at["line_dedup"] if r.doc_id in roots)

    size = {r.doc_id: len(plain.WORD.findall(r.text)) for r in at["simhash_near_dedup"]}
    own = defaultdict(list)
    for r in at["simhash_near_dedup"]:
        own[r.source].append(size[r.doc_id])
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(own, key=lambda s: (s is None, s)))}
    total, full = 1.5 * sum(map(sum, own.values())), set()
    while True:
        level = (total - sum(2 * sum(own[s]) for s in full)) / sum(weight[s] for s in own if s not in full)
        over = {s for s in own if s not in full and 2 * sum(own[s]) < level * weight[s]}
        if not over:
            break
        full |= over
    taken = Counter()
    for r in at["mixing"]:
        taken[r.source] += size[r.doc_id]
    for s, sizes in own.items():
        target = 2 * sum(sizes) if s in full else level * weight[s]
        assert abs(taken[s] - target) <= sum(sorted(sizes)[-2:])  # the landing decides two documents
    before = {r.doc_id: r for r in at["simhash_near_dedup"]}
    assert all(before[r.doc_id] == r for r in at["mixing"])

    word, digest = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter()
    for r in at["mixing"]:
        ids = word.encode(r.text, add_special_tokens=False).ids
        digest[r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
               hashlib.sha256(word.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in last) == digest
