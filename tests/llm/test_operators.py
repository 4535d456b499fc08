"""Each operator against a plain version on a small table with nulls, empty and long texts, ties, repeated rows and
clashing extra columns, and on an empty table."""

import hashlib
import io
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cattedra.llm import (ann, block_topk, bpe, katz, line_dedup, mixing, simhash, token_files, toxicity, url_filter)
from cattedra.llm.queries import URL_RULES
from tests.llm import plain

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, fp string, n_lines string"
SHARED = "A shared line\n"


def _texts():
    rng = random.Random(7)
    vocab = ["the", "of", "Été", "straße", "x1", "don't", "naïve", "日本語", "end.", "a-b", "ΣΑΣ", "worthless", "🙂"]
    out = []
    for i in range(60):
        n = rng.choice([1, 3, 8, 40])
        body = " ".join(rng.choice(vocab) for _ in range(n))
        out.append((SHARED if i % 4 == 0 else "") + body + ("\n \tA SHARED LINE \r\nlast" if i % 5 == 0 else ""))
    long_text = " ".join(rng.choice(vocab) for _ in range(30_000))
    return [*out, None, "", "\n", " \t ", "<|endoftext|> and <|startoftext|>", long_text, long_text, long_text + " one"]


TEXTS = _texts()
ROWS = [(i, t, "en", None if i % 9 == 0 else f"s{i % 3}", None, "clash", "clash", "clash") for i, t in enumerate(TEXTS)]
ROWS += [ROWS[1], ROWS[1], (None, "a null id", "en", "s1", 1, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_row(rows, *cols):
    return Counter(tuple(r[c] for c in cols) for r in rows)


def test_bpe_round_trip(docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    clash = docs.withColumn("token_ids", F.lit("clash")).withColumn("decoded", F.lit(1))
    got = bpe.round_trip(clash, path).collect()
    assert len(got) == len(ROWS)
    for r in got:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.token_ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False)
    again = bpe.decode(bpe.encode(docs, path), path).select("decoded")
    assert Counter(r.decoded for r in again.collect()) == Counter(r.decoded for r in got)
    assert bpe.round_trip(none, path).count() == 0


def test_memo_holds_no_long_pretokens():
    word = bpe.WordBpe(public_tokenizers.path("word_bpe_49k.json"))
    first = [x.tolist() for x in word.encode(["ab " + "x" * 5000, "x" * 5000])]
    assert word.coder.memo.keys() == {"ab"}
    assert [x.tolist() for x in word.encode(["ab " + "x" * 5000, "x" * 5000])] == first


def test_merge_order_skips_stale_entries():
    merges = {(1, 2): (0, 10), (2, 3): (1, 11), (10, 3): (2, 12), (1, 1): (3, 13)}
    assert bpe.merge_symbols([1, 2, 3], merges) == [12]
    assert bpe.merge_symbols([1, 1, 1], merges) == [13, 1]
    assert bpe.merge_symbols([2, 3, 2, 3, 1], merges) == [11, 11, 1]
    assert bpe.merge_symbols([], merges) == [] and bpe.merge_symbols([5], merges) == [5]


def test_line_dedup(docs, none):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(plain.LOW)
    lines = [(t or "").split("\n") for _, t, *_ in ROWS]
    found = Counter(k for ls in lines for k in {key(x) for x in ls if key(x)})
    want = Counter()
    for (i, *_), ls in zip(ROWS, lines):
        keep = [x for x in ls if found[key(x)] < 10]
        want[i, len(ls), len(ls) - len(keep), "\n".join(keep) if keep else None] += 1
    assert any(n >= 10 for n in found.values())
    for batches, fanout in ((1, 2), (4, 2), (5, 3)):
        got = line_dedup.dedup_lines(docs, batches=batches, fanout=fanout).collect()
        assert by_row(got, "doc_id", "n_lines", "n_dropped", "kept_text") == want
    assert line_dedup.dedup_lines(none).count() == 0


def test_line_runs_are_compacted(spark, docs):
    runs = line_dedup.LineRuns(spark, min_docs=10, fanout=2)
    for batch in line_dedup.batches_of(docs, 4):
        runs.add(batch)
    assert [len(x) for x in runs.levels] == [0, 0, 1]
    keys = [tuple(r) for r in spark.read.parquet(runs.levels[2][0]).select("h1", "h2").collect()]
    assert len(keys) == len(set(keys))


def test_line_dedup_plan_has_no_python(docs, capsys):
    line_dedup.dedup_lines(docs).explain()
    assert "Python" not in (text := capsys.readouterr().out) and "Arrow" not in text and "Pandas" not in text


def test_toxicity(spark, none):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(1200):
        toxic = i % 5 == 0
        text = [rng.choice(words) for _ in range(60)]
        if toxic:
            text[rng.randrange(60)] = rng.choice(["scum", "trash"])
        rows.append((i, " ".join(text), int(toxic)))
    frame = spark.createDataFrame([*rows, (-1, None, 0), (-2, "", None), (None, "scum", 1)], "doc_id long, text string, toxic int")
    learn = frame.where("doc_id % 3 <> 1").select("doc_id", "toxic")
    model = toxicity.fit(frame.drop("toxic"), learn)
    got = toxicity.score(frame.withColumn("score", F.lit("clash")), model).collect()
    assert len(got) == 1203 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id > 0 and r.doc_id % 3 == 1]
    assert np.mean([r.predicted == r.toxic for r in held]) > 0.97
    again = toxicity.fit(frame.drop("toxic").repartition(7), learn)
    assert again.bias == model.bias and (again.at == model.at).all()
    blank = toxicity.fit(none, learn.limit(0))
    assert toxicity.score(none, blank).count() == 0
    assert {r.score for r in toxicity.score(frame.limit(3), blank).collect()} == {0.5}


def _vectors(spark, n=400, d=8, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.normal(size=d) * (3 if i % 50 == 0 else 1)).round(3).tolist()) for i in range(n)]
    rows += [(n + i, rows[5][1]) for i in range(60)]  # copies, some of them queries
    rows += [rows[7], rows[7], *[rows[9]] * 30]  # rows alike are candidates each
    good = list(rows)
    rows += [(n + 101, None), (n + 102, [1.0] * (d - 1) + [None]), (n + 103, [float("nan")] * d),
             (n + 104, [float("inf")] * d), (n + 105, [1.0]), (None, [1.0] * d), (n + 107, [])]
    zero = (n + 120, [0.0] * d)
    frame = spark.createDataFrame([(*r, 1, "x") for r in [*rows, zero]], "vec_id long, embedding array<float>, rank int, score string")
    return frame, [(i, np.float32(v).tolist()) for i, v in good], (zero[0], zero[1])


def _lists(rows):
    got = defaultdict(dict)
    for r in rows:
        got[r.query_id][r.rank] = (r.vec_id, r.score)
    return {q: [x[k] for k in sorted(x)] for q, x in got.items()}


def test_ann(spark):
    frame, rows, _ = _vectors(spark)
    got, want = _lists(ann.search(frame).collect()), plain.nearest(rows, lambda v: v)
    assert got.keys() == want.keys() and all(len(x) == 20 for x in got.values())
    score = {q: dict(plain.nearest(rows, lambda v: v, k=len(rows))[q]) for q in want}
    hits = 0
    for q, found in got.items():
        assert [x for x in found] == sorted(found, key=lambda x: (-x[1], x[0]))
        assert all(abs(score[q][i] - s) < 1e-12 and i != q for i, s in found)
        hits += len({i for i, _ in found} & {i for i, _ in want[q]})
    assert hits / (20 * len(want)) >= 0.9
    exact = _lists(ann.search(frame, share=1.0).collect())
    assert {q: [i for i, _ in x] for q, x in exact.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    few = _lists(ann.search(frame.where("vec_id < 5")).collect())
    assert len(few[0]) == 4
    assert ann.search(frame.limit(0)).count() == 0


def test_block_topk(spark):
    frame, rows, zero = _vectors(spark)
    want = plain.nearest([*rows, zero], lambda v: np.floor(64 * v).astype(int))
    got = _lists(block_topk.search(frame).collect())
    assert got == {q: [(i, int(s)) for i, s in x] for q, x in want.items()}
    assert len(_lists(block_topk.search(frame.where("vec_id < 5")).collect())[0]) == 4
    assert block_topk.search(frame.limit(0)).count() == 0


def test_block_topk_over_many_cells(spark, monkeypatch):
    monkeypatch.setattr(block_topk, "RANGE", 16)
    monkeypatch.setattr(block_topk, "CHUNK", 2)
    frame, rows, zero = _vectors(spark)
    want = plain.nearest([*rows, zero], lambda v: np.floor(64 * v).astype(int), every=5)
    got = _lists(block_topk.search(frame, every=5).collect())
    assert got == {q: [(i, int(s)) for i, s in x] for q, x in want.items()}


def test_block_bounds_prune_and_stay_exact():
    rng = np.random.default_rng(0)
    middles = rng.integers(-400, 400, (60, 16))
    v = (middles[rng.integers(0, 60, 6000)] + rng.integers(-30, 30, (6000, 16))).astype(np.int64)
    q = v[::150]
    code = block_topk.place_codes(v.astype(float), block_topk.centres_of(v[::4]))
    at = np.lexsort((np.arange(len(v)), code))
    index = block_topk.RangeIndex(at, v[at])
    assert (index.bounds(q) >= np.maximum.reduceat(q @ v[at].T, index.starts, axis=1)).all()
    for (reps, scores), row in zip(index.search(q, np.full(len(q), -10**9), 21), q @ v.T):
        want = np.lexsort((np.arange(len(v)), -row))[:21]
        assert reps.tolist() == want.tolist() and scores.tolist() == row[want].tolist()
    assert index.scored < 0.25 * len(q) * len(index.starts)


def test_repeated_rows_are_candidates_and_queries(spark):
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [0.0, 2.0]), *[(3, [1.0, 1.0])] * 4, (4, [-1.0, 0.5])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    want = Counter()
    for at, (i, v) in enumerate(rows):
        if i % 20 == 0:
            found = sorted((-64 * 64 * np.dot(v, w), j) for b, (j, w) in enumerate(rows) if b != at)
            want.update((i, rank + 1, j, int(-s)) for rank, (s, j) in enumerate(found[:5]))
    got = block_topk.search(frame, k=5).collect()
    assert Counter((r.query_id, r.rank, r.vec_id, r.score) for r in got) == want
    near = ann.search(frame, k=5).collect()
    assert Counter((r.query_id, r.rank, r.vec_id, int(64 * 64 * r.score)) for r in near) == want


def test_ann_takes_little_of_alike_vectors_and_scores_pairs_once():
    rng = np.random.default_rng(1)
    loose, middles = rng.normal(size=(3000, 24)), rng.normal(size=(80, 24))
    tight = middles[rng.integers(0, 80, 3000)] + 0.15 * rng.normal(size=(3000, 24))
    shares = []
    for v in (loose, tight):
        norm = np.sqrt((v * v).sum(axis=1).max())
        forest = ann.Forest.fit(ann._lifted(v, norm), 4, 6)
        shares.append(ann.share_for(forest, v, norm, 20))
        leaves, q = forest.leaves(ann._lifted(v, norm)), v[::20]
        sizes = np.stack([np.bincount(x, minlength=64) for x in leaves])
        seen = np.zeros((len(q), 4, 64), bool)
        for i, x in enumerate(q):
            seen[i, *np.array(forest.search(np.append(x, 0.0), sizes, 4 * shares[-1] * len(v))).T] = True
        met, found = np.zeros((len(q), len(v)), int), np.full((len(q), len(v)), -np.inf)
        for t in range(4):
            for leaf in range(64):
                own, at = np.flatnonzero(seen[:, t, leaf]), np.flatnonzero(leaves[t] == leaf)
                got = ann.new_scores(t, q[own], seen[own], v[at], leaves.T[at])
                met[np.ix_(own, at)] += got > -np.inf
                found[np.ix_(own, at)] = np.maximum(found[np.ix_(own, at)], got)
        taken = np.any([seen[:, t][:, leaves[t]] for t in range(4)], axis=0)
        assert (met == taken).all() and np.allclose(found[taken], (q @ v.T)[taken])
        near = np.argsort(-(q @ v.T), axis=1)[:, :21]
        assert np.take_along_axis(taken, near, axis=1).mean() > 0.9
    assert shares[1] < shares[0] / 2
    assert ann.depth_for(10 ** 6, 4096) == 10 > ann.depth_for(10 ** 5, 4096) == 7 > ann.depth_for(2000, 4096) == 6


@pytest.mark.parametrize("url, want", [
    ("http://WWW.Example.com/en/x?y", ("www.example.com", "/en/x", "www.example.com/en/", "allow")),
    ("http://a.example.com/en/", ("a.example.com", "/en/", "example.com/en/", "block")),
    ("http://a.example.com/en", ("a.example.com", "/en", "com/", "allow")),
    ("https://x.net/es/1#z", ("x.net", "/es/1", "net/es/", "block")),
    ("https://x.net/es", ("x.net", "/es", None, "deny")),
    ("http://com", ("com", "", None, "deny")),
    ("http://a.com?x=/", ("a.com", "", None, "deny")),
    ("http://xnet/es/", ("xnet", "/es/", None, "deny")),
    ("a://b://c.com/", ("b:", "//c.com/", None, "deny")),
    ("no scheme.com/", ("", "", None, "deny")), ("", ("", "", None, "deny")), (None, ("", "", None, "deny"))])
def test_url_parts(url, want):
    host, path = url_filter.parse_url(url)
    hit = url_filter.judge_url(url_filter.build_trie(URL_RULES), host, path)
    assert (host, path, hit and hit[1], hit[0] if hit else "deny") == want


def test_longest_of_many_rules_at_one_node():
    rng = random.Random(3)
    some = lambda n: "".join(rng.choice("ab/") for _ in range(n))
    rules = {(f"{h}com", "/" + some(rng.randint(0, 6))): rng.choice(["allow", "block"]) for h in ("", "x.") for _ in range(150)}
    root = url_filter.build_trie([(v, h, p) for (h, p), v in rules.items()])
    for _ in range(500):
        host, path = rng.choice(["com", "x.com", "y.x.com"]), "/" + some(9)
        fits = [(len(h + p), len(h), h + p, v) for (h, p), v in rules.items()
                if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert url_filter.judge_url(root, host, path) == (max(fits)[3:] + max(fits)[2:3] if fits else None)


def test_url_filter_frame(spark):
    rows = [(1, "http://a.com/", "clash"), (1, "http://a.com/", "clash"), (2, None, None), (None, "http://q.net/fr/" + "x" * 100_000, "h")]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, host string"), URL_RULES)
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    assert by_row(got.collect(), "page_id", "rule", "verdict") == Counter(
        {(1, "com/", "allow"): 2, (2, None, "allow"): 1, (None, "net/fr/", "block"): 1})
    assert url_filter.judge(got.limit(0), URL_RULES).count() == 0
    partial = url_filter.build_trie([("block", "com", "/ab"), ("allow", "com", "/abc/d"), ("allow", "", "/all")])
    assert url_filter.judge_url(partial, "x.com", "/abd")[1] == "com/ab"
    assert url_filter.judge_url(partial, "x.com", "/abc/de")[1] == "com/abc/d"
    assert url_filter.judge_url(partial, "x.org", "/all/y")[1] == "/all"


def test_rules_beyond_the_broadcast_are_joined(spark, monkeypatch):
    rng = random.Random(5)
    some = lambda n: "".join(rng.choice("ab/") for _ in range(rng.randint(0, n)))
    hosts = ["com", "x.com", "y.x.com", "", "é.com", "x..com", "x.", "com."]
    rules = [(rng.choice(["allow", "block"]), rng.choice(hosts), rng.choice(["", "/"]) + some(5)) for _ in range(400)]
    urls = [f"{rng.choice(['http', ''])}://{rng.choice(hosts + ['Q.X.com', 'q.org'])}/{some(8)}{rng.choice(['', '?a', '#/b'])}" for _ in range(600)]
    urls += [None, "", "no scheme", "a://", "a://b://c.com/", "http://x.com/" + "ab/" * 30_000, "http://x.com/a\nb/a", "http://com?x", urls[0]]
    frame = spark.createDataFrame([(i // 2, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, rule string").repartition(3)
    cols = ("page_id", "url", "host", "path", "rule", "verdict")
    want = url_filter.judge(frame, rules, default="none")
    monkeypatch.setattr(url_filter, "MAX_RULES", 10)
    got = url_filter.judge(frame, rules, default="none")
    assert got.columns == want.columns == list(cols)
    monkeypatch.undo()
    assert by_row(got.collect(), *cols) == by_row(want.collect(), *cols)
    none = spark.createDataFrame([], "verdict string, host string, path string")
    assert {(r.rule, r.verdict) for r in url_filter.judge(frame, none).collect()} == {(None, "allow")}


def test_mixing(docs, none):
    got = mixing.mix(docs).collect()
    sizes = [len(plain.WORD.findall(t or "")) for _, t, *_ in ROWS]
    assert by_row(got, "doc_id", "size") == Counter((i, n) for (i, *_), n in zip(ROWS, sizes))
    own = defaultdict(int)
    for (_, _, _, s, *_), n in zip(ROWS, sizes):
        own[s] += n
    order = sorted(own, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    full, level = set(), 0.0
    while True:
        level = (1.5 * sum(own.values()) - sum(2 * own[s] for s in full)) / sum(weight[s] for s in order if s not in full)
        over = {s for s in order if s not in full and 2 * own[s] < level * weight[s]}
        if not over:
            break
        full |= over
    for r in got:
        assert r.source_size == own[r.source]
        assert r.target == pytest.approx(2 * own[r.source] if r.source in full else level * weight[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
    again = mixing.mix(docs.repartition(5)).collect()
    assert by_row(got, "doc_id", "taken") == by_row(again, "doc_id", "taken")
    mixed = mixing.mix(docs)
    taken = mixing.take(docs, mixed)
    assert taken.columns == docs.columns and taken.count() == sum(r.copies for r in got)
    assert mixing.mix(none).count() == 0 and mixing.take(none, mixing.mix(none)).count() == 0


def test_cube_balances():
    rng = np.random.default_rng(5)
    sizes = np.exp(rng.normal(5, 1.3, 600)).astype(int)
    hits = np.zeros(600)
    for seed in range(40):
        x = mixing.fly(sizes, np.full(600, 0.3), seed, land=True)
        assert set(x) <= {0.0, 1.0} and abs(x.sum() - 180) <= 2
        assert abs((x * sizes).sum() / (0.3 * sizes.sum()) - 1) < 0.01
        hits += x
    assert abs(hits.mean() / 40 - 0.3) < 0.01 and hits.std() / 40 < 0.15
    left = mixing.fly(sizes, np.full(600, 0.3), 1, land=False)
    assert ((left > 0) & (left < 1)).sum() <= 2
    assert mixing.fly(np.zeros(4), np.full(4, 0.5), 0, True).sum() == 2
    assert len(mixing.fly(np.zeros(0), np.zeros(0), 0, True)) == 0


def test_token_files(docs, none, scratch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    manifest = token_files.write_tokens(docs, path, end_id=2, folder=f"file://{scratch}/t")
    got = token_files.read_tokens(manifest).collect()
    want = Counter()
    for i, t, *_ in ROWS:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want[i, len(ids), np.array(ids, "<u4").tobytes()] += 1
    assert by_row(got, "doc_id", "n_tokens", "ids") == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ordered = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ordered == sorted(ordered, key=lambda d: (d is not None, d))
    some = token_files.read_tokens(manifest, wanted=[1, 62]).collect()
    assert by_row(some, "doc_id", "start", "ids") == Counter({k: n for k, n in by_row(got, "doc_id", "start", "ids").items() if k[0] in (1, 62)})
    assert token_files.read_tokens(token_files.write_tokens(none, path, 2)).count() == 0


def test_token_file_reads_only_wanted_frames_and_checks_them():
    out = io.BytesIO()
    documents = [(i, np.arange(i, i + 50, dtype="<u4")) for i in range(20)]
    token_files.write_file(out, documents, frame_ids=100)
    data = out.getvalue()
    file = token_files.TokenFile(io.BytesIO(data), len(data))
    assert len(file.frames) == 10
    assert [np.frombuffer(raw, "<u4").tolist() for *_, raw in file.documents()] == [x.tolist() for _, x in documents]
    broken = bytearray(data)
    broken[int(file.offsets[3]) + 12] ^= 0xFF
    damaged = token_files.TokenFile(io.BytesIO(bytes(broken)), len(data))
    assert next(damaged.documents({19}))[0] == 19  # other frames are not touched
    with pytest.raises(Exception):
        list(damaged.documents({6}))


def test_simhash(docs, none):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    assert by_row(got, "doc_id", "fp") == Counter(
        (i, np.uint64(plain.simhash(t)).view(np.int64).item()) for i, t, *_ in ROWS)
    named = {i: plain.simhash(t) for i, t, *_ in ROWS if i is not None}
    root = plain.components(named)
    assert all(r.component_id == root[r.doc_id] for r in got if r.doc_id is not None)
    kept = simhash.keep_one(docs, simhash.near_duplicates(docs))
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(root.values()))
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none, simhash.near_duplicates(none)).count() == 0


def test_simhash_links_are_complete(spark):
    rng = random.Random(11)
    base = [rng.getrandbits(64) for _ in range(40)]
    near = [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(6)]
    prints = sorted({np.uint64(x).view(np.int64).item() for x in [*base, *near, 0, 3, (1 << 64) - 1, (1 << 64) - 4]})
    for bits in (1, 2, 3):
        want = {(a, b) for k, a in enumerate(prints) for b in prints[k + 1:] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= bits}
        got = [tuple(r) for r in simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), bits).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    roots = {r.fp: r.root for r in simhash.components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")).collect()}
    assert roots == {i: 0 for i in range(41)}


@pytest.mark.parametrize("sizes", [{}, {"block_tokens": 2000, "hot": 200}])
def test_katz(docs, none, sizes):
    frame = docs.withColumn("learn", F.col("doc_id") % 4 != 1)
    tokens = [plain.words(t) + ["\n"] for _, t, *_ in ROWS]
    learn = [i is not None and i % 4 != 1 for i, *_ in ROWS]
    model = plain.Katz([t for t, y in zip(tokens, learn) if y])
    got = katz.train_and_score(frame, "learn", **sizes).collect()
    want = sorted((i if i is not None else -1, y, len(t), sum(model.c1[w] > 0 for w in t), model.n, round(model.base(t), 5),
                   round(model.score(t), 5)) for (i, *_), t, y in zip(ROWS, tokens, learn))
    mine = sorted((r.doc_id if r.doc_id is not None else -1, r.learn, r.n_tokens, r.n_known, r.train_tokens,
                   round(r.base_score, 5), round(r.score, 5)) for r in got)
    assert [x[:5] for x in mine] == [x[:5] for x in want]
    assert np.allclose([x[5:] for x in mine], [x[5:] for x in want], rtol=1e-9, atol=1e-4)
    for h in [None, "the", "of", "never seen"]:
        whole = sum(model.pair(h, w) for w in model.c1) + model.pair(h, "a word not seen")
        assert whole == pytest.approx(1.0)


def test_katz_without_training_rows(docs, none):
    got = katz.train_and_score(docs.withColumn("learn", F.lit(False)), "learn").collect()
    assert len(got) == len(ROWS) and all(r.n_known == 0 and r.score == 0 for r in got)
    assert katz.train_and_score(none.withColumn("learn", F.lit(True)), "learn").count() == 0


def test_mixing_makes_up_for_long_documents_over_many_chunks(spark):
    rng = np.random.default_rng(2)
    rows = []
    for s, longs in (("a", [100_000]), ("b", [60_000, 90_000, 40_000]), ("c", [30_000])):
        sizes = [*np.exp(rng.normal(5, 0.8, 2500)).astype(int).tolist(), *longs]
        rows += [(f"{s}{i}", "w " * n, s) for i, n in enumerate(sizes)]
    rows = [(k, t, s) for k, (_, t, s) in enumerate(rows)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    for share in (0.4, 0.9, 1.5):
        got = mixing.mix(frame, share=share).collect()
        assert len(got) == len(rows) and len({r.doc_id for r in got}) == len(rows)
        for s in "abc":
            own = [r for r in got if r.source == s]
            target, whole = own[0].target, own[0].source_size
            assert abs(sum(r.taken for r in own) - target) <= 2 * whole / mixing.LONG
            copies = target / whole
            assert all(int(copies) <= r.copies <= int(copies) + 1 for r in own)


def _recall(got, want):
    assert got.keys() == want.keys() and all(len(x) == 20 for x in got.values())
    return np.mean([len({i for i, _ in x} & {i for i, _ in want[q]}) / 20 for q, x in got.items()])


@pytest.mark.parametrize("table", ["sf0.1", "generated"])
def test_ann_recall_where_leaves_are_skipped(spark, table):
    if table == "generated":
        v = np.random.default_rng(4).normal(size=(5000, 32)).astype(np.float32)
        rows = [(i, x.tolist()) for i, x in enumerate(v / np.linalg.norm(v, axis=1)[:, None])]
        frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    else:
        frame = spark.read.parquet(f"/root/testdata/{table}/embeddings.parquet")
        rows = [(r.vec_id, r.embedding) for r in frame.collect()]
    want = plain.nearest(rows, lambda v: v)
    recall = _recall(_lists(ann.search(frame).collect()), want)
    assert recall >= 0.93
    assert _recall(_lists(ann.search(frame, share=0.1).collect()), want) < recall  # the share is what bounds the search


def test_block_topk_of_large_components_and_every_length(spark):
    rng = np.random.default_rng(6)
    rows = [(i, np.float32(rng.normal(size=6)).tolist()) for i in range(150)]
    # components beyond 2^27, 2^31 and 2^53, products of 20 with 40 near a long's range with a bound beyond it
    large = {7: [3e6, 0.5, -1.0, 2e6, 3e6, 1.0], 20: [0.0, 5e6, -3e6, 0.0, 1.0, 0.0], 31: [-4e7, 1.0, 2.0, -4e7, 0.0, 0.0],
             40: [10.0, 3e8, 4e8, 0.0, 0.0, 0.0], 53: [0.0, 0.0, 0.0, 2.5e14, 1.0, -1e13], 61: [1e13, 1.0, -2.0, 0.0, 0.0, 0.0]}
    rows = [(i, large.get(i, v)) for i, v in rows]
    other = [(1000 + i, np.float32(rng.normal(size=3)).tolist()) for i in range(40)]
    frame = spark.createDataFrame([*rows, *other], "vec_id long, embedding array<double>").repartition(3)

    def best(table):
        whole = {i: [int(np.floor(64 * np.float64(x))) for x in v] for i, v in table}
        return {q: sorted(((i, sum(a * b for a, b in zip(whole[q], v))) for i, v in whole.items() if i != q),
                          key=lambda x: (-x[1], x[0]))[:20] for q in whole if q % 20 == 0}

    want = {**best(rows), **best(other)}
    assert _lists(block_topk.search(frame).collect()) == want
    got = _lists(ann.search(frame.where("vec_id >= 1000"), share=1.0).collect())
    both = _lists(ann.search(frame, share=1.0).collect())
    twice = spark.createDataFrame([(20, [1e10]), (21, [1e10]), (22, [2.0])], "vec_id long, embedding array<double>")
    assert _lists(block_topk.search(twice.where("vec_id <> 21")).collect()) == {20: [(22, 640_000_000_000 * 128)]}
    with pytest.raises(Exception, match="range of a long"):
        block_topk.search(twice).collect()
    assert both.keys() == want.keys() and {q: both[q] for q in got} == got


def test_products_beyond_a_long():
    q, v = np.array([[2 ** 40, 1], [3, 4]]), np.array([[2 ** 30, -5], [-(2 ** 22), 2 ** 62]])
    assert block_topk.exact_product(q[1:], v[:1]).tolist() == [[3 * 2 ** 30 - 20]]
    assert block_topk.exact_product(q, v).tolist() == [[2 ** 63 - 1, 2 ** 62 - 2 ** 62], [3 * 2 ** 30 - 20, 2 ** 63 - 1]]
    sums = block_topk.exact_product(np.array([[2 ** 33, 2 ** 33]]), np.array([[2 ** 31, -(2 ** 31) + 1]]))
    assert sums.tolist() == [[2 ** 33]]


def test_files_follow_the_input(spark, scratch, monkeypatch):
    """Tables are written by more tasks the more their input holds; small ones by few."""
    from cattedra.llm import common
    spark.range(20_000).withColumn("x", F.rand(1)).repartition(200).write.parquet(f"{scratch}/t")
    df = spark.read.parquet(f"{scratch}/t")
    monkeypatch.setattr(common, "BYTES_A_FILE", 1 << 30)
    least = 4 * spark.sparkContext.defaultParallelism
    spread = df.repartition(400, "id")
    assert common.fewer_files(spread).rdd.getNumPartitions() == least
    monkeypatch.setattr(common, "BYTES_A_FILE", common.bytes_read(df) // 150)
    assert 140 < common.fewer_files(spread).rdd.getNumPartitions() <= 152
    assert common.bytes_read(spark.createDataFrame([(1,)], "a int")) < 1 << 20


class PlainFtrl:
    """FTRL-proximal by the formulas, one coordinate at a time."""

    def __init__(self, alpha, beta, l1, l2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = defaultdict(float), defaultdict(float)

    def weight(self, i):
        l1, l2 = (0.0, 0.0) if i == "bias" else (self.l1, self.l2)
        if abs(self.z[i]) <= l1:
            return 0.0
        sign = -1.0 if self.z[i] < 0 else 1.0
        return -(self.z[i] - sign * l1) / ((self.beta + self.n[i] ** 0.5) / self.alpha + l2)

    def learn(self, at, y):
        at = [*at, "bias"]
        w = {i: self.weight(i) for i in at}
        g = 1 / (1 + 2.718281828459045 ** -sum(w.values())) - y
        for i in at:
            sigma = ((self.n[i] + g * g) ** 0.5 - self.n[i] ** 0.5) / self.alpha
            self.z[i] += g - sigma * w[i]
            self.n[i] += g * g


def test_ftrl_against_plain_formulas():
    rng = np.random.default_rng(8)
    fast, slow = toxicity.Ftrl(alpha=0.7, beta=0.5, l1=0.3, l2=0.2), PlainFtrl(0.7, 0.5, 0.3, 0.2)
    for _ in range(400):
        at = np.sort(rng.choice(40, rng.integers(1, 9), replace=False))
        y = int(rng.random() < (0.9 if 3 in at or 5 in at else 0.2))
        fast.learn(at, y)
        slow.learn(at.tolist(), y)
    assert fast.bias() == pytest.approx(slow.weight("bias"))
    got = fast.weights(np.arange(40))
    assert got == pytest.approx([slow.weight(i) for i in range(40)])
    assert (got == 0).any() and got[3] > 0.5 and got[5] > 0.5


def test_toxicity_features_are_words_pairs_and_skips():
    row, at = toxicity.features(["a b c d", "b", "", None, "a b"])
    of = lambda i: set(at[row == i].tolist())
    single, pair = of(1), of(4) - {*of(1)}
    assert len(of(0)) == 4 + 3 + 2 and single <= of(0) and not of(2) and not of(3)
    assert pair <= of(0) and len(pair) == 2  # the word a and the pair a b
    assert of(0) & set(toxicity.features(["a x c"])[1].tolist()) == set(toxicity.features(["a"])[1].tolist()) | set(
        toxicity.features(["c"])[1].tolist()) | (set(toxicity.features(["a y c"])[1].tolist()) & set(toxicity.features(["a x c"])[1].tolist()))


def test_cube_moves_stay_in_the_null_space(monkeypatch):
    """Every move of the flight keeps both totals and ends with a probability at 0 or 1; a plain flight in the same null space
    has the same inclusion probabilities."""
    rng = np.random.default_rng(4)
    sizes, pi = np.exp(rng.normal(3, 1, 40)).round(), np.full(40, 0.35)

    def plain_flight(seed):
        x, r = pi.copy(), np.random.default_rng(seed)
        while True:
            open_ = np.flatnonzero((x > 1e-9) & (x < 1 - 1e-9))
            if len(open_) < 3:
                return x
            u = np.linalg.svd(np.stack([np.ones(len(open_)), sizes[open_] / sizes.mean()]))[2][-1]
            up = min(((1 - p) / d if d > 0 else -p / d) for p, d in zip(x[open_], u) if abs(d) > 1e-12)
            down = min((p / d if d > 0 else (p - 1) / d) for p, d in zip(x[open_], u) if abs(d) > 1e-12)
            x[open_] += (up if r.random() * (up + down) < down else -down) * u

    mine, plain = [], []
    for seed in range(250):
        x = mixing.fly(sizes, pi, seed, land=False)
        assert x.sum() == pytest.approx(pi.sum()) and (x * sizes).sum() == pytest.approx((pi * sizes).sum())
        assert ((x > 0) & (x < 1)).sum() <= 2
        mine.append(x)
        plain.append(plain_flight(seed))
    assert np.abs(np.mean(mine, axis=0) - 0.35).max() < 0.12 and np.abs(np.mean(plain, axis=0) - 0.35).max() < 0.12
    assert abs(np.mean(mine) - np.mean(plain)) < 1e-9


def test_folders_of_a_block_are_deleted_but_the_kept(spark):
    from cattedra.llm import common
    made = []
    write = lambda name: made.append(common.write_shared(spark.range(3), name)) or made[-1]
    there = lambda df: os.path.exists(df.inputFiles()[0].removeprefix("file:").replace("//", "/"))
    with pytest.raises(ZeroDivisionError), common.temporary(spark):
        inner = write("lost")
        with common.temporary(spark, keep="stays"):
            write("lost")
            kept = write("stays")
        assert there(kept) and kept.count() == 3 and not there(made[1]) and there(inner)
        1 / 0
    assert not there(kept) and not there(inner) and not common._blocks
    assert there(write("free"))


@pytest.mark.parametrize("run", [lambda df: simhash.near_duplicates(df), lambda df: mixing.mix(df.withColumn("source", F.lit("s"))),
                                 lambda df: katz.train_and_score(df.withColumn("learn", F.lit(True)), "learn")])
def test_ids_as_texts_and_ids_that_are_no_numbers(spark, run):
    some = lambda *ids: spark.createDataFrame([(i, f"words of {i} here") for i in ids], "doc_id string, text string")
    assert {r.doc_id for r in run(some("3", "12")).collect()} == {3, 12}
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        run(some("3", "x1")).collect()
