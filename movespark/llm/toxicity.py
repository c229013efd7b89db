"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words and their beginnings of a few bytes, all that the examples have. A term weighs (1 + log tf) * idf, by
its document frequency over all documents, times how much it says about the label among the examples (its share of
the information on the class, and a small constant for terms that say nothing). A text's nearest examples are
found exactly: postings of rarer terms are added up, frequent terms are bounded by their largest weight in each block of
examples, and blocks are completed only where partial sum and bound reach the nearest found. Votes weighted by
distance are calibrated on the examples, each left out in turn.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, documents, fold, give_back, lean, stage
from .textblock import blocks

#: Terms: runs of letters and digits, A-Z lower-cased; bytes over 127 (parts of characters outside ASCII) count as letters.
_BETWEEN = np.array([not (chr(b).isalnum() and b < 128) and b < 128 for b in range(256)])
#: Bytes of the beginnings of longer words that are terms too: words are inflected and compounded.
BEGINNINGS = (4, 6)
#: Examples of a block, neighbours that vote, entries of the dense table of frequent terms, texts searched together, and the weight of a term that says nothing.
BLOCK, NEAREST, DENSE, TOGETHER, PLAIN = 64, 25, 1 << 22, 64, 0.1
#: Bytes of the texts whose terms are found together: each of them takes some 50 bytes meanwhile.
AT_ONCE = 1 << 19


def training(labels: DataFrame, folds: int, held: int) -> DataFrame:
    """Labels to learn from: a row (doc_id, toxic) for each id outside the held-out fold. An id with both labels is toxic."""
    rows = labels.where("doc_id is not null and toxic in (0, 1)")
    if folds:
        rows = rows.where(fold(F.col("doc_id"), folds) != held)
    return rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def labelled(rows: DataFrame, per_class: int) -> dict[int, int]:
    """Up to per_class ids of either class, those of smallest hash: the bound of what the classifier is fitted on."""
    found: dict[int, int] = {}
    for kind in (0, 1):
        found |= {r.doc_id: kind for r in rows.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).select("doc_id").collect()}
    return found


def terms_of(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """For blocks of texts: ascending distinct terms (hashes), and for each occurrence its text and its term; and the number of texts."""
    for b in blocks(texts, lower=True, between=_BETWEEN, size=AT_ONCE):
        h, word = b.with_beginnings(BEGINNINGS)
        text = np.repeat(np.arange(len(b.n_words)), b.n_words)[word]
        known, term = np.unique(h, return_inverse=True)
        yield known, text, term, len(b.n_words)


def counted(texts: pa.Array, vocabulary: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For blocks of texts: where each text's terms begin and the last ends, the numbers of its terms in the vocabulary, ascending, and how often it has each."""
    size = max(1, len(vocabulary))
    for known, text, term, n in terms_of(texts):
        at = np.minimum(np.searchsorted(vocabulary, known), size - 1)
        number = np.where(vocabulary[at] == known, at, -1) if len(vocabulary) else np.full(len(known), -1)
        number = number[term]
        ok = number >= 0
        key, tf = np.unique(text[ok] * size + number[ok], return_counts=True)
        yield np.searchsorted(key, np.arange(n + 1) * size), key % size, tf


def example_terms(docs: DataFrame, examples: dict[int, int]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(doc_id, terms, counts) of the labelled texts. Where an id occurs with several texts, the one of smallest hash is taken."""
    ids = docs.sparkSession.createDataFrame([(d,) for d in examples], "doc_id long")
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    one = docs.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64(text).alias("h"), text.alias("text"))).alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for known, text, term, n in terms_of(batch.column(1)):
                key, tf = np.unique(text * len(known) + term, return_counts=True)
                edges = np.searchsorted(key, np.arange(n + 1) * len(known))
                out += [(known[key[a:z] % len(known)].tobytes(), tf[a:z].astype("<u4").tobytes()) for a, z in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([o[k] for o in out], pa.binary()) for k in (0, 1))], names=["doc_id", "terms", "tfs"])

    rows = stage(one.select(F.col("doc_id").cast("long").alias("doc_id"), "m.text").mapInArrow(lean(run), "doc_id long, terms binary, tfs binary"), "examples")
    # one partition after the other, for the driver's memory
    found = [(r.doc_id, np.frombuffer(r.terms, np.uint64), np.frombuffer(r.tfs, "<u4").astype(np.int32)) for r in rows.toLocalIterator()]
    discard(rows)
    return found


def document_frequencies(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many of all documents each term is, and how many documents there are.

    Each task adds up its documents and passes on one compressed vector; these are added up in a tree.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def packed(total: np.ndarray, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([zlib.compress(total.tobytes(), 1)], pa.binary()), pa.array([n], pa.int64())], names=["df", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(sent.value), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, terms, _ in counted(batch.column(0), sent.value):
                total += np.bincount(terms, minlength=len(total))[: len(total)]
        if n:
            yield packed(total, n)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(sent.value), np.int64), 0
        for batch in batches:
            for v, k in zip(batch.column(0), batch.column(1).to_pylist()):
                total, n = total + np.frombuffer(zlib.decompress(v.as_py()), np.int64), n + k
        if n:
            yield packed(total, n)

    parts = stage(docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(lean(count), "df binary, n long"), "frequencies")
    tasks = parts.count()
    while tasks > 16:
        tasks = -(-tasks // 16)
        parts = parts.repartition(tasks).mapInArrow(lean(add), "df binary, n long")
    total, n = np.zeros(len(vocabulary), np.int64), 0
    for r in parts.collect():
        total, n = total + np.frombuffer(zlib.decompress(r.df), np.int64), n + r.n
    return total, n


def information(present: np.ndarray, toxic: np.ndarray, n: int, n_toxic: float) -> np.ndarray:
    """Share of the information on the class that a term's presence gives, less what the luckiest of as many terms gives by chance."""
    clean, n_clean = present - toxic, n - n_toxic
    rate = present / max(n, 1)

    def part(k: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(k > 0, k * np.log(np.maximum(k, 1e-300) / np.maximum(expected, 1e-300)), 0.0)

    g = part(toxic, n_toxic * rate) + part(clean, n_clean * rate) + part(n_toxic - toxic, n_toxic * (1 - rate)) + part(n_clean - clean, n_clean * (1 - rate))
    share = n_toxic / max(n, 1)
    whole = -n * sum(p * np.log(p) for p in (share, 1 - share) if p > 0)
    return np.maximum(g - np.log(max(len(present), 1)), 0.0) / max(whole, 1e-12)


@dataclass
class Index:
    """Examples in blocks, with postings of rarer terms, weights of frequent ones and their largest in each block."""

    vocabulary: np.ndarray
    factor: np.ndarray  # idf by what the term says about the class
    ids: np.ndarray
    toxic: np.ndarray  # shares of toxic documents among those with this vector, and how much they weigh
    weight: np.ndarray
    begin: np.ndarray  # postings of the rarer terms
    example: np.ndarray
    value: np.ndarray
    row: np.ndarray  # rows of the frequent ones, -1 for the others
    dense: np.ndarray  # blocks, frequent terms, examples of a block
    largest: np.ndarray
    steps: tuple[np.ndarray, np.ndarray]
    prior: float

    @classmethod
    def build(cls, rows: list[tuple[int, np.ndarray, np.ndarray]], examples: dict[int, int], vocabulary: np.ndarray, idf: np.ndarray, rate: float, dense: int = DENSE) -> Index:
        """rows: (doc_id, numbers of terms in the vocabulary, ascending, and how often it has each). The list is emptied, for the driver's memory."""
        groups: dict[tuple[bytes, bytes], list] = {}
        for doc, terms, tfs in sorted(rows, key=lambda r: r[0]):
            groups.setdefault((terms.astype(np.int32).tobytes(), tfs.astype(np.int32).tobytes()), []).append(doc)
        n = [max(1, sum(examples[r[0]] == k for r in rows)) for k in (0, 1)]
        of_class = [(1 - rate) / n[0], rate / n[1]]  # so that both classes weigh as in the corpus
        empty = groups.pop((b"", b""), [])
        prior = sum(of_class[1] for d in empty if examples[d]) / max(sum(of_class[examples[d]] for d in empty), 1e-12) if empty else rate
        # like ones into one block: by class, then by their most frequent terms
        keys = sorted(groups, key=lambda k: (examples[groups[k][0]], np.frombuffer(k[0], np.int32)[np.argsort(idf[np.frombuffer(k[0], np.int32)], kind="stable")[:8]].tolist(), groups[k][0]))
        ids = np.array([groups[k][0] for k in keys], np.int64)
        mass = np.array([[sum(of_class[examples[d]] for d in groups[k] if examples[d]), sum(of_class[examples[d]] for d in groups[k])] for k in keys]).reshape(-1, 2)
        vectors = [(np.frombuffer(a, np.int32), np.frombuffer(b, np.int32)) for a, b in keys]
        rows.clear()
        kinds = np.array([sum(examples[d] for d in groups[k]) / len(groups[k]) for k in keys])
        size, m = len(idf), len(keys)
        present, toxic = np.zeros(size), np.zeros(size)
        for (t, _), kind in zip(vectors, kinds):
            present[t] += 1
            toxic[t] += kind
        says = information(present, toxic, m, kinds.sum())
        factor = idf * (PLAIN * (says.max(initial=0.0) or 1.0) + says)
        # the most frequent terms go to the dense table, as many as it holds
        n_blocks = max(1, -(-m // BLOCK))
        often = np.argsort(-present, kind="stable")[: dense // (n_blocks * BLOCK)]
        often = np.sort(often[present[often] > 8])
        row = np.full(size, -1, np.int32)
        row[often] = np.arange(len(often))
        table = np.zeros((n_blocks, len(often), BLOCK), np.float32)
        begin = np.concatenate([[0], np.cumsum(np.where(row < 0, present, 0))]).astype(np.int64)
        example, value, at = np.empty(begin[-1], np.int32), np.empty(begin[-1], np.float32), begin[:-1].copy()
        for k, (t, f) in enumerate(vectors):
            w = (1 + np.log(f)) * factor[t]
            w = (w / np.sqrt(w @ w)).astype(np.float32)
            hot = row[t] >= 0
            table[k // BLOCK, row[t[hot]], k % BLOCK] = w[hot]
            place = at[t[~hot]]
            example[place], value[place] = k, w[~hot]
            at[t[~hot]] += 1
        self = cls(vocabulary, factor.astype(np.float32), ids, mass[:, 0] / mass[:, 1], mass[:, 1], begin, example, value, row, table,
                   table.max(2).T.astype(np.float64).copy(), (np.array([0.0]), np.array([rate])), prior)
        if m:
            self._calibrate(vectors, rate)
        return self

    def nearest(self, edges: np.ndarray, terms: np.ndarray, tfs: np.ndarray, k: int = NEAREST) -> tuple[np.ndarray, np.ndarray]:
        """For each text the k examples of largest cosine and these cosines (0: none), ties by position: exact.

        edges: where each text's terms begin, and the end of the last.
        """
        n, n_blocks = len(edges) - 1, len(self.dense)
        owner = np.repeat(np.arange(n), np.diff(edges))
        q = (1 + np.log(tfs)) * self.factor[terms].astype(np.float64)
        q /= np.sqrt(np.bincount(owner, q * q, n))[owner]
        # postings of the rarer terms, text by text: the sums of one stay in the cache
        sums = np.zeros((n, n_blocks * BLOCK))
        rare = np.flatnonzero(self.row[terms] < 0)
        first, count = self.begin[terms[rare]], self.begin[terms[rare] + 1] - self.begin[terms[rare]]
        cut = np.searchsorted(rare, edges)
        for i in range(n):
            b, c = first[cut[i] : cut[i + 1]], count[cut[i] : cut[i + 1]]
            total = int(c.sum())
            if total:
                at = np.repeat(b - (np.cumsum(c) - c), c)
                at += np.arange(total)
                sums[i] = np.bincount(self.example[at], self.value[at] * np.repeat(q[rare[cut[i] : cut[i + 1]]], c), sums.shape[1])
        sums = sums.reshape(n, n_blocks, BLOCK)
        # what the frequent terms may add in each block at most
        often = np.flatnonzero(self.row[terms] >= 0)
        query = np.zeros((n, self.dense.shape[1]))
        query[owner[often], self.row[terms[often]]] = q[often]
        bound = sums.max(2) + query @ self.largest
        done, best = np.zeros((n, n_blocks), bool), np.full((n, k), -1.0)
        first = np.argsort(-bound, axis=1, kind="stable")[:, :4]
        want = np.zeros((n, n_blocks), bool)
        want[np.arange(n)[:, None], first] = True
        for _ in range(2):
            for b in np.flatnonzero(want.any(0)).tolist():
                texts = np.flatnonzero(want[:, b])
                sums[texts, b] += query[texts] @ self.dense[b].astype(np.float64)
            done |= want
            cos = np.where(done[:, :, None], sums, -1.0).reshape(n, -1)
            width = min(k, cos.shape[1])
            best = -np.partition(-cos, width - 1, axis=1)[:, width - 1]
            want = ~done & (bound >= np.maximum(best, 0.0)[:, None] - 1e-9) & (bound > 0)
            if width < k:
                want = ~done
        cos = np.round(cos, 12)
        cos[:, len(self.ids):] = -1.0
        near = np.argsort(-cos, axis=1, kind="stable")[:, :k] if n * cos.shape[1] < 4096 else self._top(cos, k)
        return near, np.maximum(np.take_along_axis(cos, near, 1), 0.0)

    @staticmethod
    def _top(cos: np.ndarray, k: int) -> np.ndarray:
        """Positions of the k largest of each row, largest first, ties by position."""
        k = min(k, cos.shape[1])
        least = -np.partition(-cos, k - 1, axis=1)[:, k - 1]
        out = np.empty((len(cos), k), np.int64)
        for i, row in enumerate(cos):
            hit = np.flatnonzero(row >= least[i])
            out[i] = hit[np.argsort(-row[hit], kind="stable")[:k]]
        return out

    def vote(self, near: np.ndarray, cos: np.ndarray) -> np.ndarray:
        """Votes weigh 1 / (distance + 0.1), times how common the example is; some weight is the prior's."""
        w = np.where(cos > 0, self.weight[np.minimum(near, len(self.ids) - 1)] / (1.1 - np.minimum(cos, 1.0)), 0.0)
        return ((w * self.toxic[np.minimum(near, len(self.ids) - 1)]).sum(1) + 1e-9 * self.prior) / (w.sum(1) + 1e-9)

    def _calibrate(self, vectors: list, rate: float) -> None:
        """Pooled adjacent violators over the votes that each example gets from the others."""
        votes = np.empty(len(vectors))
        for lo in range(0, len(vectors), TOGETHER):
            part = vectors[lo : lo + TOGETHER]
            near, cos = self.nearest(np.cumsum([0, *(len(t) for t, _ in part)]), *(np.concatenate(c) for c in zip(*part)), NEAREST + 1)
            own = near == np.arange(lo, lo + len(part))[:, None]
            own[~own.any(1), -1] = True  # pushed out by others as near: leave out the last instead
            keep = np.argsort(own, axis=1, kind="stable")[:, : near.shape[1] - 1]
            votes[lo : lo + len(part)] = self.vote(np.take_along_axis(near, keep, 1), np.take_along_axis(cos, keep, 1))
        pools: list[list[float]] = []
        for k in np.argsort(votes, kind="stable"):
            pools.append([votes[k], self.toxic[k] * self.weight[k], self.weight[k]])
            while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
                v, a, n = pools.pop()
                pools[-1] = [v, pools[-1][1] + a, pools[-1][2] + n]
        floor = self.weight.min() * rate
        self.steps = np.array([p[0] for p in pools]), np.array([(p[1] + floor * rate) / (p[2] + floor) for p in pools])

    def scores(self, edges: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
        """Calibrated scores, and the ids of the three nearest examples as evidence. A text that has no term of any example gets the prior."""
        n = len(edges) - 1
        out, evidence = np.full(n, self.prior), [[] for _ in range(n)]
        if len(self.ids):
            for lo in range(0, n, TOGETHER):
                hi = min(n, lo + TOGETHER)
                some = np.flatnonzero(np.diff(edges[lo : hi + 1])) + lo
                if not len(some):
                    continue
                a, z = edges[lo], edges[hi]
                near, cos = self.nearest(np.append(edges[some], z) - a, terms[a:z], tfs[a:z])
                out[some] = np.interp(self.vote(near, cos), *self.steps)
                for i, ks, c in zip(some.tolist(), near[:, :3], cos[:, :3]):
                    evidence[i] = self.ids[ks[c > 0]].tolist()
        return np.clip(out, 0.0, 1.0), evidence


def learn(docs: DataFrame, labels: DataFrame, folds: int, held: int, per_class: int) -> Index:
    """The index of the labelled examples outside the held-out fold, with document frequencies of all documents."""
    rows = stage(training(labels, folds, held), "labels")
    examples = labelled(rows, per_class)
    rate = rows.agg(F.avg(F.col("toxic").cast("double"))).collect()[0][0] or 0.0
    found = example_terms(docs, examples) if examples else []
    vocabulary = np.empty(0, np.uint64)
    for lo in range(0, len(found), 512):
        vocabulary = np.union1d(vocabulary, np.unique(np.concatenate([t for _, t, _ in found[lo : lo + 512]])))
    for k, (d, t, f) in enumerate(found):
        found[k] = d, np.searchsorted(vocabulary, t).astype(np.int32), f
    give_back()
    df, n = document_frequencies(docs, vocabulary) if len(vocabulary) else (np.empty(0, np.int64), 0)
    idf = np.log((n + 1) / (df + 1)) + 0.1
    return Index.build(found, examples, vocabulary, idf, min(max(rate, 1e-4), 0.5))


class Judge:
    """Scores texts of a task by the index; equal texts, of which there may be many, once."""

    MOST = 20_000

    def __init__(self, index: Index):
        self.index, self.memo = index, {}

    def __call__(self, texts: pa.Array) -> list[tuple[float, list[int]]]:
        """The score and the evidence of each text; null texts are empty."""
        if len(self.memo) > self.MOST:
            self.memo.clear()
        keys = [xxhash.xxh3_128_digest(t.as_buffer() or b"") for t in texts]
        new = {k: i for i, k in enumerate(keys) if k not in self.memo}
        order, at = list(new), 0
        for edges, terms, tfs in counted(texts.take(pa.array(list(new.values()), pa.int64())), self.index.vocabulary):
            for s, e in zip(*(x if isinstance(x, list) else x.tolist() for x in self.index.scores(edges, terms, tfs))):
                self.memo[order[at]] = s, e
                at += 1
        return [self.memo[k] for k in keys]


def _sent(docs: DataFrame, labels: DataFrame, folds: int, held: int, per_class: int) -> Broadcast:
    """The index as a broadcast; what learning it took of the driver's memory is given back."""
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, folds, held, per_class))
    give_back()
    return sent


def score(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, per_class: int = 4000) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted, evidence), one for each row of docs.

    Null and empty texts have no terms and get the score of labelled texts without terms. Only doc_id and text of
    docs are read, and doc_id only to find labelled texts; nothing is learned from labels of the held-out fold. Ties
    among neighbours go to the example of smaller position; repeated rows get equal scores. Without labels every
    score is the smallest base rate.
    """
    sent = _sent(docs, labels, folds, held, per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(sent.value)
        for batch in batches:
            scores, evidence = (list(c) for c in zip(*judge(batch.column(1)))) if batch.num_rows else ([], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(evidence, pa.list_(pa.int64()))],
                                             names=["doc_id", "score", "predicted", "evidence"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(lean(run), f"doc_id {kind}, score double, predicted int, evidence array<bigint>")
    held_out = fold(F.col("doc_id"), folds) == held if folds else F.lit(False)
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted", "evidence")


def keep_clean(docs: DataFrame, labels: DataFrame, per_class: int = 4000) -> DataFrame:
    """The documents, with their columns, whose whole text isn't predicted to be toxic. Labels teach, but decide on no document.

    Null and empty texts are judged as labelled texts without terms are. Scores are made by row and not joined back by
    id, so null and repeated ids are no matter; columns of any name pass; an empty table gives an empty one.
    """
    sent = _sent(docs, labels, 0, 0, per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(sent.value)
        for batch in batches:
            found = judge(batch.column(batch.schema.get_field_index("text")).cast(pa.binary()))
            yield batch.filter(pa.array([s < 0.5 for s, _ in found], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
