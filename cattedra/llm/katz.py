"""Katz backoff language model over word pairs, counted, normalised and evaluated in blocks that Spark shuffles.

Model: P(w | h) = d(c) c(h,w) / c(h) for pairs seen in training, else alpha(h) P(w); P(w) = d(c) c(w) / N, and what is left
of the word level's mass is the probability of the one unknown word. d is the Good-Turing discount for counts up to
``K`` (counts above are trusted); where the counts of counts give no discount in (0, 1) it is (r - 1/2) / r. alpha(h) is
the mass that the discounts leave, divided by the word-level mass of the words not seen after h, summed over all
words seen after h, so that each context's probabilities sum to one. A context without any discounted pair counts one
more unseen word. The first token's context is the start of the text; a context never seen in training backs off with
weight one.

Work: documents are cut into *blocks* of whole texts, ``BLOCK`` tokens or one long text each. A block sends each of its
distinct words (then pairs) once, with its training count, to the *bucket* of that word (then context); buckets add
up, store the model tables (partitioned by kind: word counts; pair counts with context sums) and answer each block in its
own order. So a word with a third of all tokens is one entry per block. A context with more than ``HOT`` tokens is
spread over several buckets by the second word; its sums, one row per bucket, are merged at the end. At most N / HOT
contexts are that hot, so their table may be broadcast. Blocks then score their tokens, recursively: pair if seen, else
backoff weight and word.

Words are named by their 64-bit XXH64. Two words of one hash would count as one word: among V distinct words some such pair
is there with a probability of about V^2 / 2^65 (3 in 10,000 for 100 million words, 3 in 100 for a billion).

Texts: null is empty; every text has one end token. Rows whose ``learn`` is null or false are scored only. Repeated
rows count as often as they occur. With no training row every probability falls to the unknown word, which then has
all mass. An empty table gives an empty result. Extra columns are ignored.
Ids (doc_id) are whole numbers within a long, or texts of such; any other id stops the query.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cattedra.llm.common import lower_text, ship, slices, write_shared

BLOCK, BLOCK_DOCS, HOT, K = 1 << 20, 1 << 16, 1 << 20, 5
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Keys of the end token and of the start of a text: no word holds a blank.
END, START = xxhash.xxh64_intdigest("\n"), np.uint64(1) << np.uint64(62)
UNKNOWN = np.uint64(1) << np.uint64(61)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def pack(a: np.ndarray) -> bytes:
    """Bytes of equal weight stand together, so that the many zero bytes vanish."""
    a = np.ascontiguousarray(a)
    raw = a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes() if a.size else b""
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1).view(kind)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return (x ^ (x >> np.uint64(32))) * _MIX >> np.uint64(8)


def spans(sorted_keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of the keys 0..n-1 begins, and the end."""
    return np.searchsorted(sorted_keys, np.arange(n + 1))


def discounts(ones: list[int]) -> np.ndarray:
    """d[1..K] from counts of counts n_1..n_{K+1} (d[0] unused, d[K+1] = 1 for all higher counts)."""
    n = [0, *ones]
    d = np.ones(K + 2)
    tail = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    for r in range(1, K + 1):
        good = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) if n[r] and tail < 1 else 0.0
        d[r] = good if 0 < good < 1 else (r - 0.5) / r
    return d


@dataclass
class WordLevel:
    """Totals of the training words: tokens, distinct words, counts of counts."""

    n: int
    v: int
    ones: list[int]

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        """P(w) by training count; the unknown word's for count 0."""
        if not self.n:
            return np.ones(len(counts))
        d = discounts(self.ones)
        left = sum(self.ones[r - 1] * r * (1 - d[r]) for r in range(1, K + 1)) / self.n
        scale = 1.0
        if left <= 0:  # no word occurs K times or less: one more token is the unknown word
            left, scale = 1 / (self.n + 1), self.n / (self.n + 1)
        return np.where(counts > 0, scale * d[np.minimum(counts, K + 1)] * counts / self.n, left)


def _blob_rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)


_BLOCK_SCHEMA = pa.schema([("kind", pa.string()), ("block", pa.int64()), ("bucket", pa.int64()), ("a", pa.binary()),
                           ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary()), ("e", pa.binary())])
_SQL = "kind string, block long, bucket long, a binary, b binary, c binary, d binary, e binary"


def make_blocks(df: DataFrame, buckets: int, block_tokens: int = BLOCK) -> DataFrame:
    """Rows of kind ``block`` (a: ids, b: null marks, c: learn marks, d: tokens of each document, e: tokens as places in the
    block's sorted words) and ``words`` (per bucket of the hash; a: words, b: training counts). ``buckets``: 2^n."""
    shift = np.uint64(64 - (buckets.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, ids, learn, hashed, size = 0, [], [], [], 0

        def close():
            nonlocal made, ids, learn, hashed, size
            lens = np.array([len(h) for h in hashed], np.uint64)
            words, places = np.unique(np.concatenate(hashed), return_inverse=True)
            taught = np.repeat(np.array(learn, np.uint8), lens.astype(np.int64))
            counts = np.bincount(places, taught, len(words)).astype(np.uint32)
            block = (TaskContext.get().partitionId() << 32) + made
            rows = [("block", block, -1, pack(np.array([x or 0 for x in ids], np.int64)),
                     pack(np.array([x is None for x in ids], np.uint8)), pack(np.array(learn, np.uint8)), pack(lens),
                     pack(places.astype(np.uint32)))]
            at = spans(words >> shift if buckets > 1 else np.zeros(len(words), np.uint64), buckets)
            rows += [("words", block, int(k), pack(words[at[k]:at[k + 1]]), pack(counts[at[k]:at[k + 1]]), None, None, None)
                     for k in np.flatnonzero(np.diff(at))]
            made, ids, learn, hashed, size = made + 1, [], [], [], 0
            return _blob_rows(rows, _BLOCK_SCHEMA)

        for part in slices(batches, "text"):
            for doc, text, taught in zip(*(c.to_pylist() for c in part.columns)):
                words = _WORD.findall(lower_text(text or ""))
                h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
                ids.append(doc)
                learn.append(bool(taught))
                hashed.append(np.append(h, np.uint64(END)))
                size += len(words) + 1
                if size >= block_tokens or len(ids) >= BLOCK_DOCS:
                    yield close()
        if ids:
            yield close()

    return df.mapInArrow(run, _SQL)


def _add_words(hot: int):
    return lambda key, group: _word_bucket(key, group, hot)


def _word_bucket(key, group: pa.Table, hot: int) -> pa.Table:
    """A bucket of words: answers to each block (a: word ids, b: counts) and the table (a: words, b: counts, c: counts of
    counts, tokens, distinct words, d: ids of words that are hot contexts)."""
    bucket, n_buckets = key[0].as_py(), key[1].as_py()
    blocks = group.column("block").to_pylist()
    words = [unpack(x, np.uint64) for x in group.column("a").to_pylist()]
    counts = [unpack(x, np.uint32) for x in group.column("b").to_pylist()]
    distinct, at = np.unique(np.concatenate(words), return_inverse=True)
    total = np.bincount(at, np.concatenate(counts), len(distinct)).astype(np.int64)
    # frequent words first: small ids
    place = np.empty(len(distinct), np.uint64)
    place[np.argsort(-total, kind="stable")] = np.arange(len(distinct), dtype=np.uint64)
    ids = place * np.uint64(n_buckets) + np.uint64(bucket)
    ones = np.bincount(np.minimum(total, K + 2), minlength=K + 3)[1:K + 2]
    stats = np.array([*ones, total.sum(), (total > 0).sum()], np.int64)
    rows, start = [("table", -1, bucket, pack(distinct[total > 0]), pack(total[total > 0]), stats.tobytes(),
                     ids[total >= hot].tobytes(), None)], 0
    for block, w in zip(blocks, words):
        mine = at[start:start + len(w)]
        rows.append(("answer", block, bucket, pack(ids[mine]), pack(total[mine].astype(np.uint64)), None, None, None))
        start += len(w)
    return pa.Table.from_batches([_blob_rows(rows, _BLOCK_SCHEMA)])


@dataclass
class Tokens:
    """A block with the answers to its words, and its distinct pairs in the order in which they are sent."""

    doc: np.ndarray
    learn: np.ndarray
    lens: np.ndarray
    place: np.ndarray
    count: np.ndarray
    pair: np.ndarray      # per token: place of its pair among those sent, or -1 if its context is unknown
    context: np.ndarray   # per sent pair
    word: np.ndarray
    word_count: np.ndarray
    context_count: np.ndarray
    bucket: np.ndarray

    @classmethod
    def of(cls, block: dict, ids: np.ndarray, counts: np.ndarray, train_docs: int, buckets: int, hot: int) -> Tokens:
        lens = unpack(block["d"], np.uint64).astype(np.int64)
        learn = unpack(block["c"], np.uint8)
        place = unpack(block["e"], np.uint32).astype(np.int64)
        doc = np.repeat(np.arange(len(lens)), lens)
        known = np.where(counts > 0, ids, UNKNOWN)
        n_words = len(ids)
        before = np.empty(len(place), np.int64)
        before[1:] = place[:-1]
        before[np.cumsum(lens) - lens] = n_words  # the start of a text
        c_id = np.append(known, START)
        c_count = np.append(counts, train_docs).astype(np.int64)
        asks = c_count[before] > 0
        key = before[asks] * n_words + place[asks]
        distinct, at = np.unique(key, return_inverse=True)
        ci, wi = distinct // n_words, distinct % n_words
        context, word, many = c_id[ci], known[wi], c_count[ci]
        salts = (many // hot + 1).astype(np.uint64)
        bucket = (mix(context + mix(word) % salts * _MIX) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((word, context, bucket))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        pair = np.full(len(place), -1)
        pair[asks] = rank[at]
        return cls(doc, learn, lens, place, counts.astype(np.int64), pair, context[order], word[order],
                   counts[wi][order].astype(np.int64), many[order], bucket[order])

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and length of each run of one context in one bucket."""
        new = np.ones(len(self.context), bool)
        new[1:] = (self.context[1:] != self.context[:-1]) | (self.bucket[1:] != self.bucket[:-1])
        start = np.flatnonzero(new)
        return start, np.diff(np.append(start, len(self.context)))


def _joined(answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Answers of all word buckets in order: the block's sorted words."""
    rows = sorted(answers.select(["bucket", "a", "b"]).to_pylist(), key=lambda r: r["bucket"])
    return (np.concatenate([unpack(r["a"], np.uint64) for r in rows]),
            np.concatenate([unpack(r["b"], np.uint64) for r in rows]))


def _send_pairs(train_docs: int, buckets: int, hot: int):
    def run(key, block, answers):
        t = Tokens.of(block.to_pylist()[0], *_joined(answers), train_docs, buckets, hot)
        taught = t.learn[t.doc] & (t.pair >= 0)
        counts = np.bincount(t.pair[t.pair >= 0], taught[t.pair >= 0], len(t.word)).astype(np.uint32)
        start, length = t.runs()
        step = np.diff(t.word, prepend=np.uint64(0))
        step[start] = t.word[start]  # within a run words ascend
        run_at, pair_at = spans(t.bucket[start], buckets), spans(t.bucket, buckets)
        rows = []
        for k in np.flatnonzero(np.diff(pair_at)):  # buckets that get anything
            (i, j), (p, q) = run_at[k:k + 2], pair_at[k:k + 2]
            rows.append(("pairs", key[0].as_py(), int(k), pack(t.context[start[i:j]]), pack(length[i:j].astype(np.uint32)),
                         pack(step[p:q]), pack(counts[p:q]), pack(t.word_count[p:q].astype(np.uint64))))
        return pa.Table.from_batches([_blob_rows(rows, _BLOCK_SCHEMA)] if rows else [], _BLOCK_SCHEMA)

    return run


def _add_pairs(level: WordLevel):
    """A bucket of pairs: answers to each block (a: pair counts, b: per context run, whether it has discounted pairs,
    c: runs with unseen pairs, d: their discountable pairs by count, e: their seen word mass) and the table (a: contexts, b:
    seen pairs of each, c: words, d: counts, e: counts of counts, then each context's discountable pairs and word mass)."""
    def run(key, group):
        sent = group.to_pylist()
        contexts, lengths, words, counts, w_counts = [], [], [], [], []
        for r in sent:
            contexts.append(unpack(r["a"], np.uint64))
            lengths.append(unpack(r["b"], np.uint32).astype(np.int64))
            total = np.cumsum(unpack(r["c"], np.uint64))
            start = np.cumsum(lengths[-1]) - lengths[-1]
            words.append(total - np.repeat(np.where(start > 0, total[start - 1], 0).astype(np.uint64), lengths[-1]))
            counts.append(unpack(r["d"], np.uint32))
            w_counts.append(unpack(r["e"], np.uint64))
        known, run_at = np.unique(np.concatenate(contexts), return_inverse=True)
        length = np.concatenate(lengths)
        vocab, word_at = np.unique(np.concatenate(words), return_inverse=True)
        pairs, first, at = np.unique(np.repeat(run_at, length) * len(vocab) + word_at, return_index=True,
                                     return_inverse=True)
        count = np.bincount(at, np.concatenate(counts), len(pairs)).astype(np.int64)
        ctx, seen = pairs // len(vocab), count > 0
        mass = level.probabilities(np.concatenate(w_counts)[first].astype(np.int64))
        seen_mass = np.bincount(ctx[seen], mass[seen], len(known))
        by_count = np.stack([np.bincount(ctx[count == r], minlength=len(known)) for r in range(1, K + 1)], axis=1)
        ones = np.bincount(np.minimum(count, K + 2), minlength=K + 3)[1:K + 2].astype(np.int64)
        rows = [("table", -1, key[0].as_py(), pack(known), pack(np.bincount(ctx[seen], minlength=len(known))),
                 pack(vocab[pairs[seen] % len(vocab)]), pack(count[seen]),
                 ones.tobytes() + by_count.astype(np.int64).tobytes() + seen_mass.tobytes())]
        p = q = 0
        for r, own_lengths in zip(sent, lengths):
            n_runs, n_pairs = len(own_lengths), int(own_lengths.sum())
            mine, own = count[at[p:p + n_pairs]], run_at[q:q + n_runs]
            unseen = np.add.reduceat((mine == 0).astype(np.int64), np.cumsum(own_lengths) - own_lengths) > 0
            rows.append(("answer", r["block"], r["bucket"], pack(mine.astype(np.uint32)),
                         pack((by_count[own].sum(axis=1) > 0).astype(np.uint8)),
                         pack(np.flatnonzero(unseen).astype(np.uint32)),
                         pack(by_count[own[unseen]].reshape(-1).astype(np.uint32)), pack(seen_mass[own[unseen]])))
            p, q = p + n_pairs, q + n_runs
        return pa.Table.from_batches([_blob_rows(rows, _BLOCK_SCHEMA)])

    return run


def _hot_contexts(hot_ids: np.ndarray):
    """(context, pairs by count, word mass) of the hot contexts in each bucket of the pair table."""
    names = ["context", *[f"m{r}" for r in range(1, K + 1)], "mass"]

    def run(batches):
        for batch in batches:
            for a, e in zip(*(batch.column(i).to_pylist() for i in range(2))):
                known = unpack(a, np.uint64)
                n = len(known)
                by_count = np.frombuffer(e, np.int64, n * K, 8 * (K + 1)).reshape(n, K)
                mass = np.frombuffer(e, np.float64, n, 8 * (K + 1) + 8 * n * K)
                at = np.flatnonzero(np.isin(known, hot_ids))
                yield pa.RecordBatch.from_arrays([pa.array(known[at].view(np.int64)),
                                                  *[pa.array(by_count[at, r]) for r in range(K)], pa.array(mass[at])],
                                                 names=names)

    return run


@dataclass
class PairLevel:
    """What scoring needs besides a block's answers: discounts, and sums of the hot contexts."""

    d: np.ndarray
    hot: dict[int, tuple[np.ndarray, float]]


def _score(level: WordLevel, train_docs: int, buckets: int, hot: int, shared):
    def run(key, block, answers):
        row, pairs = block.to_pylist()[0], shared.value
        kinds = answers.column("kind").to_pylist()
        mask = pa.array([k == "answer-1" for k in kinds])
        t = Tokens.of(row, *_joined(answers.filter(mask)), train_docs, buckets, hot)
        replies = sorted(answers.filter(pc.invert(mask)).to_pylist(), key=lambda r: r["bucket"])
        n_docs, n_pairs = len(t.lens), len(t.word)
        p1 = np.log10(level.probabilities(t.count))[t.place]
        logp = p1.copy()
        if n_pairs:
            count = np.concatenate([unpack(r["a"], np.uint32) for r in replies]).astype(np.int64)
            start, length = t.runs()
            c_ctx = t.context_count[start].astype(float)
            some = np.concatenate([unpack(r["b"], np.uint8) for r in replies]).astype(bool)
            by_count, mass = np.zeros((len(start), K)), np.zeros(len(start))
            p = 0
            for r in replies:
                n_runs = len(unpack(r["b"], np.uint8))
                at = unpack(r["c"], np.uint32).astype(np.int64) + p
                by_count[at] = unpack(r["d"], np.uint32).reshape(-1, K)
                mass[at] = unpack(r["e"], np.float64)
                p += n_runs
            for i in np.flatnonzero(t.context_count[start] >= hot):
                by_count[i], mass[i] = pairs.hot[int(t.context[start[i]].view(np.int64))]
                some[i] = by_count[i].sum() > 0
            left = (by_count * np.arange(1, K + 1) * (1 - pairs.d[1:K + 1])).sum(axis=1)
            total = np.where(some, c_ctx, c_ctx + 1)
            left = np.where(some, left, 1.0) / total
            run_of = np.repeat(np.arange(len(start)), length)
            with np.errstate(divide="ignore", invalid="ignore"):
                alpha = np.log10(left / (1 - mass))[run_of]  # read for unseen pairs only
                seen = np.log10(pairs.d[np.minimum(count, K + 1)] * count / total[run_of])
            has = t.pair >= 0
            pair = t.pair[has]
            logp[has] = np.where(count[pair] > 0, seen[pair], alpha[pair] + p1[has])
        base = np.log10((t.count + 0.1) / (level.n + 0.1 * (level.v + 1)))[t.place]
        sums = lambda x: np.bincount(t.doc, x, n_docs)
        ids, none = unpack(row["a"], np.int64), unpack(row["b"], np.uint8).astype(bool)
        return pa.table({"doc_id": pa.array(ids, mask=none), "learn": pa.array(t.learn.astype(bool)),
                         "n_tokens": pa.array(t.lens), "n_known": pa.array(sums(t.count[t.place] > 0).astype(np.int64)),
                         "train_tokens": pa.array(np.full(n_docs, level.n, np.int64)), "base_score": pa.array(sums(base)),
                         "score": pa.array(sums(logp))})

    return run



def _summed(table: DataFrame, column: str, n: int) -> list[int]:
    """The sums of ``n`` numbers packed in each row of ``column``: one row a task, added up by Spark."""
    def add(batches):
        total = np.zeros(n, np.int64)
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                total += np.frombuffer(packed, np.int64, n)
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], names=[f"s{i}" for i in range(n)])

    parts = table.select(column).mapInArrow(add, ", ".join(f"s{i} long" for i in range(n)))
    return [int(x or 0) for x in parts.agg(*[F.sum(f"s{i}") for i in range(n)]).first()]


_OUT = "doc_id long, learn boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def train_and_score(df: DataFrame, learn: str, doc_id: str = "doc_id", text: str = "text", block_tokens: int = BLOCK,
                    hot: int = HOT) -> DataFrame:
    """Learn from the rows marked ``learn``, score every row: doc_id, learn, n_tokens, n_known, train_tokens, base_score
    (add-0.1 words), score (log10 probability of the text under the model)."""
    spark = df.sparkSession
    ship(spark)
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"),
                     F.coalesce(F.col(learn).cast("boolean"), F.lit(False)).alias("learn"))
    size, train_docs = rows.agg(F.sum(F.octet_length("text")), F.count(F.when(F.col("learn"), 1))).first()
    tokens = (size or 0) // 6
    word_buckets = 1 << max(5, (tokens // (8 * block_tokens)).bit_length())
    buckets = max(32, tokens // (2 * block_tokens))

    made = write_shared(make_blocks(rows, word_buckets, block_tokens), "blocks", ["kind"])
    blocks = made.where("kind = 'block'")
    grouped = made.where("kind = 'words'").groupBy("bucket", F.lit(word_buckets).alias("n"))
    words = write_shared(grouped.applyInArrow(_add_words(hot), _SQL), "words", ["kind"], few=True)
    stats = words.where("kind = 'table'")
    total = _summed(stats, "c", K + 3)
    hot_rows = stats.where("length(d) > 0").select("d").collect()  # at most N / HOT hot words
    hot_ids = np.array([*(x for r in hot_rows for x in np.frombuffer(r.d, np.uint64)), START], np.uint64)
    level = WordLevel(total[K + 1], total[K + 2], total[:K + 1])
    to_block = words.where("kind = 'answer'").withColumn("kind", F.lit("answer-1"))

    sent = blocks.groupBy("block").cogroup(to_block.groupBy("block")).applyInArrow(_send_pairs(train_docs, buckets, hot), _SQL)
    pairs = write_shared(sent.groupBy("bucket").applyInArrow(_add_pairs(level), _SQL), "pairs", ["kind"], few=True)
    table = pairs.where("kind = 'table'")
    d = discounts(_summed(table, "e", K + 1))
    by_count = [f"m{r}" for r in range(1, K + 1)]
    parts = table.select("a", "e").mapInArrow(_hot_contexts(hot_ids),
                                              f"context long, {', '.join(m + ' long' for m in by_count)}, mass double")
    sums = parts.groupBy("context").agg(*[F.sum(m).alias(m) for m in by_count], F.sum("mass").alias("mass"))
    merged = {r.context: (np.array([r[m] for m in by_count], float), r.mass) for r in sums.collect()}
    shared = spark.sparkContext.broadcast(PairLevel(d, merged))  # at most N / HOT + 1 contexts
    replies = to_block.unionByName(pairs.where("kind = 'answer'"))
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(
        _score(level, train_docs, buckets, hot, shared), _OUT)
