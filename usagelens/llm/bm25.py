"""Exact top-k BM25 search: inverted index per shard, many queries scored at once.

Global statistics (documents, mean length, document frequencies) come from one
aggregation, so shard scores are comparable and the merge is exact. Queries of
like words form chunks of ``CHUNK``; documents go by the same groups into shards
of up to ``SHARD`` documents, so that a chunk and a shard share either many words
or few. A shard holds postings of impacts for the query terms, the largest impact
of every term, and for frequent terms (``DENSE`` documents of ``SHARD``, or as
large a share) a table of their impacts.

A query whose largest impacts in a shard sum up to less than its k-th best score
so far (the bar) passes the shard over. For the others of a chunk, terms that
are frequent in both are one matrix product, the rest is added up from postings,
all in single precision: sums of positive numbers, so they are off by a known
share at most. The k-th largest of the maxima over blocks of ``BLOCK`` documents
lifts the bar; blocks, then documents, that stay below the bar by more than
that share are passed over, and the others, little more than k, are scored in
full in double precision. Nothing is estimated, so the k best are exact.

Words travel as hashes; that no two words of queries and documents are mixed up
is checked, and another hash is taken if so. Queries travel in blocks whose size
is bounded (``QUERY_BYTES``), each broadcast against all shards; texts are read
once for each block.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from usagelens.llm.common import col, stored
from usagelens.llm.decontam import words

K, K1, B = 10, 1.2, 0.75
SHARD, BLOCK, DENSE = 16384, 8, 1024
CHUNK = 256  # queries that are scored at once
HELD = 8 << 20  # postings that a task holds of documents not yet in a shard
STEP = 16 << 20  # of them, what the driver takes at once
QUERY_BYTES = 160 << 20  # of queries: the places of their words, ids and best results
GROUPS, FEATURES = 8, 256  # groups of like queries, told apart by the most frequent words
_SLACK = 1e-9
_LOW = 0 if sys.byteorder == "little" else 1  # where the lower half of a number lies
_ADDED = 200  # a posting that is added up costs as much as so many cells of a matrix product


def _hash(word: Column, salt: int) -> Column:
    return F.xxhash64(word, F.lit(salt))


class QueryBlock:
    """A bounded set of queries: ids, per query the places of its terms, and the
    vocabulary with global inverse document frequencies."""

    def __init__(self, ids, terms, vocab, idf, mean):
        self.ids, self.terms, self.vocab, self.idf, self.mean = ids, terms, vocab, idf, mean


def _marks(places: np.ndarray, rows: np.ndarray, n: int, feature: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Vectors of length one over the frequent terms for ``n`` texts that hold (row, term)."""
    f = feature[places]
    out = np.zeros((n, len(weight)), dtype=np.float32)
    out[rows[f >= 0], f[f >= 0]] = weight[f[f >= 0]]
    out /= np.maximum(np.sqrt(np.einsum("ij,ij->i", out, out)), 1e-9)[:, None]
    return out


def _halves(at: np.ndarray, marks: np.ndarray) -> list[np.ndarray]:
    """Chunks of like queries: halved along the direction in which they differ most."""
    if len(at) <= CHUNK:
        return [at]
    own = marks[at]
    own -= own.mean(axis=0)
    axis = np.ones(own.shape[1], dtype=np.float32)
    for _ in range(6):
        axis = own.T @ (own @ axis)
        axis /= max(float(np.linalg.norm(axis)), 1e-30)
    order = at[np.argsort(own @ axis, kind="stable")]
    half = -(-len(at) // CHUNK) // 2 * CHUNK
    return _halves(order[:half], marks) + _halves(order[half:], marks)


def _grouped(block: QueryBlock, n: np.ndarray) -> QueryBlock:
    """The block with chunks of like queries, and the centres by which documents join their groups."""
    features = np.argsort(-n, kind="stable")[:FEATURES]
    block.feature = np.full(len(n), -1, dtype=np.int32)
    block.feature[features] = np.arange(len(features))
    block.weight = block.idf[features].astype(np.float32)
    size = np.array([len(t) for t in block.terms], dtype=np.int64)
    flat = np.concatenate([*block.terms, np.zeros(0, dtype=np.int32)])
    marks = _marks(flat, np.repeat(np.arange(len(size)), size), len(size), block.feature, block.weight)
    centres = np.zeros((1, len(features)), dtype=np.float32)
    if len(marks):
        # far from each other at first: the next centre is the query least like all so far
        for _ in range(GROUPS):
            likest = (marks @ centres.T).max(axis=1)
            centres = np.concatenate([centres, marks[[np.argmin(likest)]]])
        centres = centres[1:]
        for _ in range(8):
            group = np.argmax(marks @ centres.T, axis=1)
            for g in np.unique(group):
                mid = marks[group == g].sum(axis=0)
                centres[g] = mid / max(float(np.linalg.norm(mid)), 1e-9)
        group = np.argmax(marks @ centres.T, axis=1)
        block.chunks = [c for g in np.unique(group) for c in _halves(np.flatnonzero(group == g), marks)]
    else:
        block.chunks = []
    block.centres = centres
    return block


def _impacts(tf, length, mean):
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places from ``starts`` on, ``sizes`` (one at least) of each."""
    ends = np.cumsum(sizes)
    out = np.ones(int(ends[-1]), dtype=np.int64)
    out[0] = starts[0]
    out[ends[:-1]] = starts[1:] - starts[:-1] - sizes[:-1] + 1
    return np.cumsum(out, out=out)


class Shard:
    """Postings of one shard for the terms of a query block, with impacts that
    already hold the idf: by term in single precision, for exact scores by
    document. Frequent terms also have a row of a dense table, all have their
    largest impact. ``seen`` and ``scored`` count documents of all searches: in
    the shard, and not passed over by their bounds."""

    def __init__(self, block: QueryBlock, ids, docs, terms, tfs, lengths):
        self.ids, self.idf, self.mean = np.array(ids, dtype=np.int64), block.idf, block.mean
        self.lengths = np.array(lengths, dtype=np.float64)
        docs, terms, tfs = (x[0] if len(x) == 1 else np.concatenate(x) for x in (docs, terms, tfs))
        key = docs.astype(np.int64) << 32 | terms
        order = np.argsort(key) if (key[1:] < key[:-1]).any() else slice(None)
        docs, self.own, self.tfs = docs[order], terms[order], tfs[order]
        self.own_size = np.bincount(docs, minlength=len(self.ids))
        self.own_start = np.cumsum(self.own_size) - self.own_size
        tf, norm = self.tfs.astype(np.float32), (K1 * (1 - B + B * self.lengths / self.mean)).astype(np.float32)
        value = tf * np.float32(K1 + 1) / (tf + norm[docs]) * self.idf.astype(np.float32)[self.own]
        order = np.argsort(np.left_shift(self.own, 32, out=key, dtype=np.int64) | docs)
        docs, value = docs[order], value[order]
        del key, order, tf
        self.postings = docs.astype(np.int64) << 32 | value.view(np.uint32)  # both in one number: one look-up
        self.size = np.bincount(self.own, minlength=len(block.vocab)).astype(np.int32)
        ends = np.cumsum(self.size, dtype=np.int32)
        self.starts = ends - self.size
        self.most = np.zeros(len(self.size), dtype=np.float32)
        some = np.flatnonzero(self.size)
        self.most[some] = np.maximum.reduceat(value, self.starts[some])
        self.padded = len(self.ids) + (-len(self.ids)) % BLOCK
        rows = np.flatnonzero(self.size >= max(1.0, DENSE * min(1.0, len(self.ids) / SHARD)))
        self.row = np.full(len(self.size), -1, dtype=np.int32)
        self.row[rows] = np.arange(len(rows))
        self.table = np.zeros((len(rows), self.padded), dtype=np.float32)  # a frequent term's impacts lie side by side
        for r, t in enumerate(rows):
            self.table[r, docs[self.starts[t]:ends[t]]] = value[self.starts[t]:ends[t]]
        self.member = np.zeros(len(self.size), dtype=bool)
        self.seen = self.scored = 0

    def _sums(self, n: int, terms: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Scores in single precision, (n queries, padded), for terms with the number of their query."""
        dense = self.row[terms]
        often = np.bincount(dense[dense >= 0], weights=self.size[terms[dense >= 0]], minlength=len(self.table))
        rows = np.flatnonzero(often * _ADDED > n * self.padded)
        column = np.full(len(self.table) + 1, -1, dtype=np.int32)  # the last one stands for terms without a row
        column[rows] = np.arange(len(rows))
        place = column[dense]
        wanted = np.zeros((n, len(rows)), dtype=np.float32)
        wanted[query[place >= 0], place[place >= 0]] = 1
        total = wanted @ self.table[rows]
        rest, query = terms[place < 0], query[place < 0]
        most = int(np.bincount(query, weights=self.size[rest], minlength=1).max())
        starts, sizes = self.starts[rest], self.size[rest]
        ends = np.searchsorted(query, np.arange(n + 1)).tolist()
        posting, doc = np.empty(most, dtype=np.int64), np.empty(most, dtype=np.int64)
        for i in range(n):
            a, b = ends[i], ends[i + 1]
            if b > a:
                at = _spans(starts[a:b], sizes[a:b])
                found = np.take(self.postings, at, out=posting[:len(at)], mode="clip")
                np.add.at(total[i], np.right_shift(found, 32, out=doc[:len(at)]), found.view(np.float32)[_LOW::2])
        return total

    def _exact(self, terms: np.ndarray, places: np.ndarray) -> np.ndarray:
        sizes = self.own_size[places]
        at = _spans(self.own_start[places], sizes)
        self.member[terms] = True
        hit = np.flatnonzero(self.member[self.own[at]])
        self.member[terms] = False
        at, doc = at[hit], np.searchsorted(np.cumsum(sizes), hit, side="right")
        value = _impacts(self.tfs[at].astype(np.float64), self.lengths[places[doc]], self.mean) * self.idf[self.own[at]]
        return np.bincount(doc, weights=value, minlength=len(places))

    def search_all(self, queries: list[np.ndarray], k: int, bars: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, places, scores) of every document that scores at least the query's bar and may be among its k best."""
        self.seen += len(self.ids) * len(queries)
        terms = np.concatenate([*queries, np.zeros(0, dtype=np.int32)])
        query = np.repeat(np.arange(len(queries)), [len(t) for t in queries])
        here = self.size[terms] > 0
        terms, query = terms[here], query[here]
        # a single-precision value is off by 9 halves of its last place at most, a sum of n by n more
        off = (np.bincount(query, minlength=len(queries)) + 16) * 2.0 ** -24
        reach = np.bincount(query, weights=self.most[terms], minlength=len(queries))
        live = np.flatnonzero((reach > 0) & (reach * (1 + off) >= bars - _SLACK))
        if not len(live):
            return
        if len(live) < len(queries):
            number = np.full(len(queries), -1)
            number[live] = np.arange(len(live))
            here = number[query] >= 0
            terms, query = terms[here], number[query[here]]
        off, bars = off[live], bars[live]
        total = self._sums(len(live), terms, query)
        blocks = self.padded // BLOCK
        maxima = total.reshape(len(live), BLOCK, blocks).max(axis=1)
        if blocks >= k:
            lifted = np.partition(maxima, -k, axis=1)[:, -k]
        elif self.padded >= k:
            lifted = np.partition(total, -k, axis=1)[:, -k]
        else:
            lifted = np.zeros(len(live))
        # bars are true scores, lifted ones are sums themselves and may be off as well
        least = np.maximum(np.maximum(bars * (1 - off), lifted * (1 - off) / (1 + off)) * (1 - off) - 2 * _SLACK, 1e-30)
        which, block = np.nonzero(maxima >= least[:, None])
        places = block[:, None] + np.arange(BLOCK) * blocks
        kept = total[which[:, None], places] >= least[which][:, None]
        which, places = np.repeat(which, BLOCK)[kept.ravel()], places[kept]
        ends = np.searchsorted(which, np.arange(len(live) + 1))
        for i in np.flatnonzero(np.diff(ends)):
            at = places[ends[i]:ends[i + 1]]
            self.scored += len(at)
            score = self._exact(queries[live[i]], at)
            good = (score > 0) & (score >= bars[i] - _SLACK)
            at, score = at[good], score[good]
            if len(at) > k:
                limit = np.partition(score, -k)[-k] - _SLACK  # ties with the k-th stay
                at, score = at[score >= limit], score[score >= limit]
            if len(at):
                yield int(live[i]), at, score

    def search(self, terms: np.ndarray, k: int, bar: float) -> tuple[np.ndarray, np.ndarray]:
        """The same for one query."""
        for _, at, score in self.search_all([terms], k, np.array([bar])):
            return at, score
        return np.zeros(0, dtype=np.int64), np.zeros(0)


class _Waiting:
    """Documents of one group that wait for their shard."""

    def __init__(self):
        self.ids, self.docs, self.terms, self.tfs, self.lengths, self.n, self.postings = [], [], [], [], [], 0, 0

    def add(self, ids, sizes, terms, tfs, lengths):
        self.docs.append(np.repeat(np.arange(self.n, self.n + len(ids), dtype=np.int32), sizes))
        for held, new in ((self.ids, ids), (self.terms, terms), (self.tfs, tfs), (self.lengths, lengths)):
            held.append(new)
        self.n, self.postings = self.n + len(ids), self.postings + len(terms)

    def join(self, other: _Waiting):
        self.docs += [d + np.int32(self.n) for d in other.docs]
        for held, new in ((self.ids, other.ids), (self.terms, other.terms), (self.tfs, other.tfs), (self.lengths, other.lengths)):
            held += new
        self.n, self.postings = self.n + other.n, self.postings + other.postings

    def shard(self, block: QueryBlock) -> Shard:
        for held in (self.docs, self.terms, self.tfs):  # one at a time, not all twice
            held[:] = [np.concatenate(held)]
        return Shard(block, np.concatenate(self.ids), self.docs, self.terms, self.tfs, np.concatenate(self.lengths))


def _found(vocab: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The places of hashes in the sorted vocabulary, -1 where they are not in it."""
    at = np.searchsorted(vocab, hashes).astype(np.int32)
    at[at == len(vocab)] = -1
    at[at >= 0] = np.where(vocab[at[at >= 0]] == hashes[at >= 0], at[at >= 0], -1)
    return at


def _counted(block: QueryBlock, batch: pa.RecordBatch):
    """Of documents with query words: ids, lengths, number of distinct words; and for all their words places and counts."""
    lists = batch.column("hs")
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    found, inverse = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
    place = _found(block.vocab, found)[inverse]
    keys = np.repeat(np.arange(len(lengths), dtype=np.int64) << 32, lengths)[place >= 0] | place[place >= 0]
    keys.sort()
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    keys, counts = keys[first], np.diff(first, append=len(keys)).astype(np.int32)
    sizes = np.bincount(keys >> 32, minlength=len(lengths))
    some = sizes > 0
    return (batch.column("id").to_numpy(zero_copy_only=False)[some], lengths[some], sizes[some],
            (keys & 0xFFFFFFFF).astype(np.int32), counts)


def _search_partition(block: QueryBlock, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.empty(31 << 20, dtype=np.uint8)  # once this is freed, glibc keeps arrays up to this size for the next ones
        scores, docs = np.zeros((len(block.ids), k)), np.zeros((len(block.ids), k), dtype=np.int64)
        filled = np.zeros(len(block.ids), dtype=np.int64)
        groups = [_Waiting() for _ in block.centres]

        def close(held: _Waiting):
            shard = held.shard(block)
            for chunk in block.chunks:
                bars = np.where(filled[chunk] == k, scores[chunk, k - 1], 0.0)
                for i, at, score in shard.search_all([block.terms[q] for q in chunk], k, bars):
                    q = chunk[i]
                    s = np.concatenate([scores[q, :filled[q]], np.round(score, 9)])
                    d = np.concatenate([docs[q, :filled[q]], shard.ids[at]])
                    best = np.lexsort((d, -s))[:k]
                    filled[q] = len(best)
                    scores[q, :len(best)], docs[q, :len(best)] = s[best], d[best]

        for batch in batches:
            if not len(block.vocab):
                continue
            ids, lengths, sizes, terms, tfs = _counted(block, batch)
            if not len(ids):
                continue
            rows = np.repeat(np.arange(len(ids)), sizes)
            group = np.argmax(_marks(terms, rows, len(ids), block.feature, block.weight) @ block.centres.T, axis=1)
            for g in np.unique(group):
                own, word = group == g, group[rows] == g
                groups[g].add(ids[own], sizes[own], terms[word], tfs[word], lengths[own])
            while sum(g.n for g in groups) >= SHARD or sum(g.postings for g in groups) >= HELD:
                largest = max(range(len(groups)), key=lambda g: groups[g].postings)
                held, groups[largest] = groups[largest], _Waiting()
                close(held)
        rest = _Waiting()  # a query costs the same overhead in every shard: small groups share one
        for g in groups:
            if g.n * 8 < SHARD:
                rest.join(g)
            else:
                close(g)
        if rest.n:
            close(rest)
        for chunk in block.chunks:
            size = filled[chunk]
            have = np.arange(k) < size[:, None]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(block.ids[chunk], size)), pa.array(docs[chunk][have]),
                                              pa.array(scores[chunk][have])], ["query_id", "doc_id", "score"])

    return run


def _blocks(queries: DataFrame, df: DataFrame, n_docs: int, mean: float) -> Iterator[QueryBlock]:
    """Query blocks of about QUERY_BYTES at most, dealt by a hash of the query id."""
    sized = stored(queries.withColumn("bytes", F.size("terms").cast("bigint") * 4 + 200), "bm25-queries")
    total = sized.agg(F.sum("bytes")).first()[0] or 0
    parts = max(1, -(-int(total) * 5 // (4 * QUERY_BYTES)))
    for part in range(parts):
        own = sized.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)
        asked = own.select(F.explode("terms").alias("asked")).distinct()
        salt = 0
        while True:
            # a query word that shares its hash with another word of the documents shows up beside that word
            known = (asked.withColumn("h", _hash(F.col("asked"), salt)).join(df.withColumn("h", _hash(F.col("term"), salt)), "h")
                     .select("h", "n", (F.col("asked") == F.col("term")).alias("same")).toArrow())
            if known["same"].to_numpy().all():
                break
            salt += 1
        hashes, n = (known[c].to_numpy() for c in ("h", "n"))
        order = np.argsort(hashes)
        vocab, n = hashes[order], n[order].astype(np.float64)
        idf = np.log(1 + (n_docs - n + 0.5) / (n + 0.5))
        ids, terms = [], []
        steps = max(1, -(-int(total) // (parts * STEP)))
        for step in range(steps):  # in steps, so that the driver holds few hashes at a time
            some = own.where(F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(steps)) == step)
            for batch in some.select("query_id", F.transform("terms", lambda t: _hash(t, salt)).alias("hashes")).toArrow().to_batches():
                at, ends = batch["hashes"].flatten().to_numpy(), np.cumsum(batch["hashes"].value_lengths().to_numpy())
                at = _found(vocab, at)
                terms += [np.sort(x[x >= 0]) for x in np.split(at, ends)[:-1]]
                ids.append(batch["query_id"].to_numpy())
        block = _grouped(QueryBlock(np.concatenate([*ids, np.zeros(0, dtype=np.int64)]), terms, vocab, idf, mean), n)
        block.salt = salt
        yield block


def search(docs: DataFrame, queries: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text",
           query_id: str = "doc_id", query_text: str = "text") -> DataFrame:
    """(query_id, rank, doc_id, score): for every query the k documents with the
    highest BM25 score over its distinct words; scores are rounded to nine
    digits, ties go to the smaller id, documents without a common word never
    match.

    Null texts have no words; rows without an id are no queries and no results,
    yet they count in the statistics; repeated documents are repeated results;
    queries with equal ids are merged (the union of their words); an empty table
    gives an empty result."""
    texts = docs.select(col(docs, id_col).cast("bigint").alias("id"), words(col(docs, text_col)).alias("ws"))
    kind = "query_id bigint, doc_id bigint, score double"
    wanted = queries.select(col(queries, query_id).cast("bigint").alias("query_id"),
                            F.array_distinct(words(col(queries, query_text))).alias("terms")).where("query_id is not null")
    wanted = wanted.where(F.size("terms") > 0).groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))
    # Document frequencies, and in a row of their own under a term no text has, the number of documents and of words.
    whole = F.lit("\0")
    terms = texts.select(F.explode(F.concat(F.array_distinct("ws"), F.array(whole))).alias("term"), F.size("ws").alias("words"))
    df = stored(terms.groupBy("term").agg(F.count("*").alias("n"), F.sum(F.when(F.col("term") == whole, F.col("words"))).alias("words")), "bm25-df")
    stats = df.where(F.col("term") == whole).select("n", (F.col("words") / F.col("n")).alias("mean")).first() or {"n": 0, "mean": 0.0}
    df = df.where(F.col("term") != whole).select("term", "n")
    # a query costs the same overhead in every shard and brings k rows from every task: tasks fill several shards, all cores tasks
    cores = docs.sparkSession.sparkContext.defaultParallelism
    tasks = cores * max(1, -(-stats["n"] // (8 * SHARD * cores)))
    found = None
    for block in _blocks(wanted, df, stats["n"], max(stats["mean"] or 0.0, 1e-9)):
        hashed = texts.where("id is not null").select("id", F.transform("ws", lambda w: _hash(w, block.salt)).alias("hs"))
        rows = hashed.coalesce(tasks).mapInArrow(_search_partition(block, k), kind)
        found = rows if found is None else found.union(rows)
    rank = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
