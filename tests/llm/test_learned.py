"""Language identification, whitening and vector codes against plain versions, on tables with nulls, empty and long texts,
repeated rows, ties, clashing columns and vectors of several lengths, and on empty tables."""

import hashlib
import math
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cattedra.llm import language_id, queries, vector_codes, whitening
from tests.llm import plain

SF = "/root/testdata/sf0.01"
WORDS = {"de": "der die und nicht über straße schön ist", "en": "the of and with this that strong is",
         "fr": "le la et être avec où ça est", "es": "el los y niño con dónde más es", "xx": "zu qa pfo lirr",
         "nl": "het een en niet straat mooi is van"}


@pytest.fixture(scope="module")
def speech(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(420):
        lang = list(WORDS)[i % 6]
        text = " ".join(rng.choice(WORDS[lang].split(), rng.integers(3, 30)))
        rows.append((i, text, lang, f"s{i % 2}", "clash"))
    rows += [rows[0], rows[0], (None, "der die und", "de", None, None), (900, None, "en", "s", None), (901, "", "fr", "s", None),
             (902, " 12 ½ 34\n_!", "de", "s", None), (903, "the of and " * 200_000, "en", "s", None), (904, "la et où", None, "s", None),
             (905, "퟿🙂", "en", "s", None)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score string").repartition(3)


def test_language_id_rows(speech):
    rows, docs = speech
    model = language_id.fit(docs.where("doc_id % 5 != 0 or doc_id is null"), max_rows=300)
    assert model.languages == {"germanic": ["de", "en", "nl"], "romance": ["es", "fr"], "other": ["xx"]}
    got = language_id.predict(docs, model).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(r[:2] for r in rows)
    assert all(0 <= r.score <= 1 for r in got)
    for r in got:
        if r.text is None or not any(map(str.isalpha, r.text)):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    known = [r for r in got if r.doc_id is not None and r.doc_id < 420]
    assert np.mean([r.lang == r.lang_pred for r in known]) > 0.97
    long = next(r for r in got if r.doc_id == 903)
    assert long.lang_pred == "en" and next(r for r in got if r.doc_id == 904).lang_pred == "fr"
    again = language_id.predict(docs.repartition(5), language_id.fit(docs.repartition(7).where("doc_id % 5 != 0 or doc_id is null"), max_rows=300))
    assert Counter((r.doc_id, r.lang_pred, round(r.score, 9)) for r in again.collect()) == Counter(
        (r.doc_id, r.lang_pred, round(r.score, 9)) for r in got)


def test_language_id_empty_and_single(speech):
    _, docs = speech
    none = language_id.fit(docs.limit(0))
    assert {(r.lang_pred, r.score) for r in language_id.predict(docs, none).collect()} == {("und", 0.0)}
    assert language_id.predict(docs.limit(0), none).count() == 0
    one = language_id.fit(docs.where("lang = 'en'"))
    assert {r.lang_pred for r in language_id.predict(docs, one).collect()} == {"en", "und"}


def test_grams_against_plain():
    texts = ["Ab c x1", "x1y", "", None, "1 2", "Été!straße", "x" * 9]
    row, bucket = language_id.grams(texts)
    for i, text in enumerate(texts):
        piece = " ".join({"Ab c x1": ["ab", "c"], "x1y": ["x", "y"]}.get(text) or language_id._WORDS.findall((text or "").lower()))
        if not piece:
            assert not (row == i).any()
            continue
        piece, want = f" {piece} ", []
        for order in range(1, 5):
            for at in range(len(piece) - order + 1):
                h = 0
                for k, c in enumerate(piece[at:at + order], 1):
                    h = (h + ord(c) + k) * 0x9E3779B97F4A7C15 % 2**64
                    h ^= h >> 29
                if order > 1 or piece[at] != " ":
                    want.append(h * 0x9E3779B97F4A7C15 % 2**64 >> 64 - language_id.BITS)
        assert Counter(bucket[row == i].tolist()) == Counter(want)


def test_long_text_in_pieces(monkeypatch):
    monkeypatch.setattr(language_id, "PIECE", 7)
    cut = language_id.grams(["abc defghij klm"])[1]
    monkeypatch.setattr(language_id, "PIECE", 1 << 20)
    parts = np.concatenate([language_id.grams([t])[1] for t in ("abc def", "ghij kl", "m")])
    assert Counter(cut.tolist()) == Counter(parts.tolist())


def test_machine_is_optimal():
    """The dual gap of the squared-hinge machine vanishes, so its weights are the minimum."""
    rng = np.random.default_rng(1)
    signs = np.where(rng.random(80) < 0.4, 1, -1)
    examples = []
    for s in signs:
        at = np.sort(rng.choice(50, 8, replace=False))
        v = rng.normal(size=8) + 0.7 * s * (at % 3 == 0)
        examples.append((at, v / np.linalg.norm(v)))
    w = language_id.separate(examples, signs)
    slack = np.maximum(0, 1 - signs * np.array([w[at] @ v for at, v in examples]))
    primal = w @ w / 2 + language_id.COST * (slack ** 2).sum()
    alpha = 2 * language_id.COST * slack  # at the optimum the multipliers are the slopes of the loss
    back = np.zeros_like(w)
    for (at, v), s, x in zip(examples, signs, alpha):
        back[at] += s * x * v
    assert np.abs(back - w).max() < 5e-3
    dual = alpha.sum() - back @ back / 2 - (alpha ** 2).sum() / (4 * language_id.COST)
    assert abs(primal - dual) < 1e-2 * primal


def test_sigmoid_is_calibrated():
    rng = np.random.default_rng(2)
    m = rng.normal(size=4000) * 1e-3
    signs = np.where(rng.random(4000) < 1 / (1 + np.exp(-(2000 * m + 0.5))), 1, -1)
    slope, offset = language_id.sigmoid(m, signs)
    assert slope == pytest.approx(2000, rel=0.15) and offset == pytest.approx(0.5, abs=0.15)


def test_family_is_multinomial(speech):
    """Family weights are the log shares of the grams of its rows, and the family with the highest mean wins."""
    _, docs = speech
    few = docs.where("doc_id < 60")
    model = language_id.fit(few, max_rows=10_000)
    rows = few.collect()
    where = {lang: f for f, own in model.languages.items() for lang in own}
    total = {f: np.full(1 << language_id.BITS, 0.5) for f in model.families}
    for r in rows:
        np.add.at(total[where[r.lang]], language_id.grams([r.text])[1], 1)
    for f, t in total.items():
        assert np.allclose(model.families[f], np.log(t / t.sum()), atol=1e-5)


def test_op11_held_out(spark):
    got = queries.op11_language_id(spark, SF).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(got) == len(truth) and all(r.held_out == (plain.crc_mod(r.doc_id, 4) == 2) for r in got)
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in got if r.held_out]) > 0.98


VECTORS = "vec_id long, embedding array<float>, label int, v string, component string, code string, error string"


def _vectors(n=300, width=12, seed=5):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, width)) * np.linspace(2.0, 0.3, width) @ np.linalg.qr(rng.normal(size=(width, width)))[0]
    rows = [(i, x.astype(np.float32).tolist(), None if i % 7 == 0 else i % 3, *["clash"] * 4) for i, x in enumerate(base)]
    rows += [rows[0]] * 40 + [rows[3], (None, rows[5][1], None, *[None] * 4), (1000, None, 1, *[None] * 4), (1001, [], 1, *[None] * 4),
                              (1002, [math.nan] + [0.0] * (width - 1), 1, *[None] * 4), (1003, [math.inf] * width, 1, *[None] * 4),
                              (1004, [None] * width, 1, *[None] * 4), (1005, [0.0] * width, 2, *[None] * 4),
                              (3, rows[9][1], 1, *[None] * 4)]
    return rows


def _kept(rows):
    return [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]


def test_whitening(spark):
    rows = _vectors()
    kept = _kept(rows)
    x = np.array([[math.floor(1024 * c) + 100_000 for c in r[1]] for r in kept])
    n, s = len(x), x.sum(axis=0)
    y = x - s / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1][:8], vectors[:, ::-1][:, :8]
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS).repartition(4)).collect()
    assert len(got) == 8 * n and {r.n for r in got} == {n}
    assert all(r.identity_error < 1e-10 for r in got) and len({r.identity_error for r in got}) == 1
    deviation = ((n * x - s) ** 2).sum(axis=1)
    assert Counter((r.vec_id, int(r.deviation)) for r in got) == Counter({k: 8 * c for k, c in Counter(
        (r[0], int(d)) for r, d in zip(kept, deviation)).items()})
    want = y @ vectors / np.sqrt(values)
    by = defaultdict(list)
    for r in got:
        by[r.component].append((r.vec_id, r.whitened))
        assert r.explained == pytest.approx(values[r.component - 1] / np.trace(y.T @ y / n), rel=1e-9)
    for c in range(8):
        order = lambda p: (p[0] is None, p[0] or 0, round(p[1], 6))
        mine = np.array([v for _, v in sorted(by[c + 1], key=order)])
        own = np.array([v for _, v in sorted([(r[0], v) for r, v in zip(kept, want[:, c])], key=order)])
        flipped = np.array([v for _, v in sorted([(r[0], -v) for r, v in zip(kept, want[:, c])], key=order)])
        assert min(np.abs(mine - own).max(), np.abs(mine - flipped).max()) < 1e-9


def test_whitening_defined_cases(spark):
    frame = lambda rows: spark.createDataFrame(rows, VECTORS)
    rest = [None] * 4
    assert whitening.whiten(frame([])).count() == 0
    assert whitening.whiten(frame([(1, [0.5, 0.25], 0, *rest)])).count() == 0  # nothing varies
    line = whitening.whiten(frame([(i, [float(i), 2.0 * i, 1.0], 0, *rest) for i in range(5)])).collect()
    assert {r.component for r in line} == {1} and all(r.explained == pytest.approx(1) for r in line)
    two = whitening.whiten(frame([(i, [float(i % 3), float(i % 2)], 0, *rest) for i in range(6)]
                                 + [(10 + i, [float(i)], 0, *rest) for i in range(3)])).collect()
    assert Counter((r.n, r.component) for r in two) == {(6, 1): 6, (6, 2): 6, (3, 1): 3}
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(frame([(1, [1e30], 0, *rest)])).collect()


def test_whitening_of_large_numbers_is_exact(spark):
    big = [(i, [float(2**40 + i * 2**18), float(i)], 0, *[None] * 4) for i in range(40)]
    x = [[1024 * int(c) + 100_000 for c in r[1]] for r in big]
    s = [sum(c) for c in zip(*x)]
    got = whitening.whiten(spark.createDataFrame(big, VECTORS)).collect()
    want = {i: sum((40 * c - t) ** 2 for c, t in zip(row, s)) for i, row in enumerate(x)}
    assert all(int(r.deviation) == want[r.vec_id] for r in got)


@pytest.mark.parametrize("spectrum", [[5, 5, 5, 5, 5, 5, 5, 1, 1, 0, 0, 0], [9, 8, 7, 6, 5, 4, 3, 2, 1, 1e-3, 0, 0],
                                      [1] * 12, [0] * 12, [1 + 1e-9, 1, 1 - 1e-9, *[1e-6] * 9]])
def test_feast_misses_none(spark, spectrum):
    q = np.linalg.qr(np.random.default_rng(4).normal(size=(12, 12)))[0]
    a = q * np.array(spectrum, float) @ q.T
    a = (a + a.T) / 2
    values, vectors = whitening.components(spark, a, 8)
    assert np.allclose(values, sorted(spectrum, reverse=True)[:8], atol=1e-12)
    assert np.abs(a @ vectors.T - vectors.T * values).max() < 1e-12
    assert np.abs(vectors @ vectors.T - np.eye(8)).max() < 1e-6
    assert all(whitening.count_above(a, x) == sum(v > x for v in spectrum) for x in (-1, 0.5, 2.5, 4.5, 20))


def _plain_codes(kept, parts=4, entries=256, rounds=4):
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, [math.floor(1024 * c) for c in r[1]]))
    x = np.array([[math.floor(1024 * c) for c in r[1]] for r in order], dtype=object)
    cut = np.array_split(np.arange(x.shape[1]), parts)
    books = [x[:entries][:, c].copy() for c in cut]

    def nearest():
        d = [((x[:, c][:, None, :] - b[None]) ** 2).sum(axis=2).astype(np.int64) for c, b in zip(cut, books)]
        return [y.argmin(axis=1) for y in d], sum(y.min(axis=1) for y in d)

    for _ in range(rounds):
        at, _ = nearest()
        for c, b, a in zip(cut, books, at):
            for e in set(a.tolist()):
                own = x[a == e][:, c]
                b[e] = [s // len(own) for s in own.sum(axis=0)]
    at, error = nearest()
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel()).encode()).hexdigest()
    labels = Counter()
    for r, e in zip(order, error):
        labels[r[2]] += int(e)
    return Counter((r[0], "".join(f"{a[i]:02x}" for a in at), int(error[i]), labels[r[2]], digest) for i, r in enumerate(order))


def _codes(df, **more):
    return Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.compress(df, **more).collect())


@pytest.mark.parametrize("entries, width", [(256, 12), (16, 12), (8, 10)])
def test_vector_codes(spark, entries, width):
    rows = _vectors(width=width)
    want = _plain_codes(_kept(rows), entries=entries)
    assert _codes(spark.createDataFrame(rows, VECTORS).repartition(4), entries=entries) == want


def test_vector_codes_in_many_chunks(spark, monkeypatch):
    rows = _vectors()
    # workers get the functions by reference, so small chunks come from many small partitions
    assert _codes(spark.createDataFrame(rows, VECTORS).repartition(40), entries=32) == _plain_codes(_kept(rows), entries=32)


def test_vector_codes_defined_cases(spark):
    frame = lambda rows: spark.createDataFrame(rows, VECTORS)
    rest = [None] * 4
    empty = vector_codes.compress(frame([]))
    assert empty.count() == 0 and {"vec_id", "code", "error", "label_error", "codebooks_sha256"} <= set(empty.columns)
    one = [(7, [0.5, 0.25, 1.0, -3.0], None, *rest)]
    assert _codes(frame(one)) == _plain_codes(one)
    mixed = vector_codes.compress(frame(one + [(8, [1.0], 2, *rest), (9, [2.0], 2, *rest)])).collect()
    assert {r.vec_id: r.code for r in mixed} == {7: "00000000", 8: "00", 9: "01"}
    large = [(i, [float(2**35 * i), float(-i), 0.0, 1.0], i % 2, *rest) for i in range(6)]
    with pytest.raises(Exception):  # (2^45)^2 leaves a long
        vector_codes.compress(frame(large), entries=2, rounds=0).collect()
    near = [(i, [float(2**18 + i), float(-i), 0.0, 1.0], i % 2, *rest) for i in range(6)]
    assert _codes(frame(near), entries=2) == _plain_codes(near, entries=2)
    with pytest.raises(ValueError):
        vector_codes.compress(frame(one), entries=300)


def test_hot_and_rare_labels_keep_their_sums(spark):
    rows = spark.range(6000).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 3 == 0, None).when(
        F.col("id") % 3 == 1, F.lit(-1)).otherwise(F.col("id")).cast("int").alias("label"), F.col("id").alias("error"))
    got = {(r.label, r.label_error) for r in vector_codes.with_label_error(rows).collect()}
    want = defaultdict(int)
    for i in range(6000):
        want[None if i % 3 == 0 else -1 if i % 3 == 1 else i] += i
    assert got == set(want.items()) and vector_codes.with_label_error(rows).count() == 6000


def test_distances_by_tables():
    rng = np.random.default_rng(6)
    for size, kind in ((500, np.int32), (1 << 20, np.int64), (1 << 40, object)):
        v = rng.integers(-size, size, (70, 5))
        book = rng.integers(-size, size, (9, 5))
        d = vector_codes.distances(*vector_codes.unpack(*vector_codes.pack(v)), book)
        assert d.dtype == kind and (d == ((v.astype(object)[:, None] - book[None]) ** 2).sum(axis=2)).all()


def test_op13_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = Counter(con.execute(f"SELECT vec_id, code, error, label_error, codebooks_sha256 FROM ({queries.ORACLE['op13_vector_codes']})").fetchall())
    assert Counter(tuple(r) for r in queries.op13_vector_codes(spark, SF).collect()) == want


def test_op12_query(spark):
    got = queries.op12_whitening(spark, SF)
    assert dict(got.dtypes)["deviation"] == "bigint"
    r = got.agg(F.count(F.lit(1)).alias("rows"), F.max("identity_error").alias("worst"), F.countDistinct("component").alias("c")).first()
    assert r.rows == 4000 and r.worst < 1e-9 and r.c == 8
