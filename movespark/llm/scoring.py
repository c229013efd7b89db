"""Scores of whole texts: add-one unigrams, and a causal self-attention model over subwords.

Words are counted over all training texts. Each word is encoded by a public byte-level vocabulary with a
space before it. The model predicts the class of the next subword from those before it; within a class, subwords
have their corpus frequencies. The model gives a word's first subword. Then either a lexicon of frequent words
completes it by their counts, or the model goes on: the rest of the subwords, and the end of the word. How
often the lexicon fails after a first subword is counted over all training words. Both ways are distributions over
words, and so is their mixture. It is mixed again with the plain frequencies of all training words.
"""

from __future__ import annotations

import base64
import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention as att
from .common import discard, documents, fold, stage

#: Words in the lexicon, the share of plain frequencies, and least steps of a training task. A task has windows for as many
#: steps: with that many or more, each is used once in a round.
LEXICON, PLAIN, STEPS = 1 << 16, 0.1, 300
PER_TASK = STEPS * att.TOGETHER
#: Rounds of averaged training, by the share of windows: one in eight for common weights to begin with, then all.
ROUNDS = (8, 1)
#: What backing off from a pair of subwords to the frequency of the second counts as.
BACK_OFF = 4.0
#: Not a word: white space.
END_WORD = b"\n"


def public_ranks(name: str = "byte_bpe_50k.tiktoken") -> dict[bytes, int]:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Subwords:
    """Subword ids of single words with a space before them."""

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        self.coder = tiktoken.Encoding("words", pat_str=r"\s?\S+", mergeable_ranks=ranks, special_tokens={})
        self.size, self.space = max(ranks.values()) + 1, ranks[b" "]
        self.begins = np.zeros(self.size, bool)
        self.begins[[i for t, i in ranks.items() if t.startswith(b" ")]] = True

    def __call__(self, word: bytes) -> list[int]:
        return self.coder.encode_ordinary(" " + word.decode("utf-8", "replace")) or [self.space]

    def many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in a row, and how many each has. They are encoded at once: a subword with a space begins a word."""
        ids = np.array(self.coder.encode_ordinary(" " + b" ".join(words).decode("utf-8", "replace")) if words else [], np.int64)
        at = np.flatnonzero(self.begins[ids])
        if len(at) == len(words):
            return ids, np.diff(np.append(at, len(ids)))
        # a word of white space outside ASCII has no subword of its own
        each = [self(w) for w in words]
        return np.array([i for s in each for i in s], np.int64), np.array([len(s) for s in each], np.int64)


def cut(ids: np.ndarray, end: int) -> list[bytes]:
    """Consecutive windows of a text's subwords, its end before and after them: each place is the target of one window."""
    row = np.concatenate([[end], ids, [end]]).astype("<u2")
    return [row[lo : lo + att.CONTEXT + 1].tobytes() for lo in range(0, len(row) - 1, att.CONTEXT)]


def _tally(docs: DataFrame, ranks_sent) -> DataFrame:
    """Staged rows (word, n) of word counts by task and (window, deal), from training texts (row, text).

    The windows of a text hold all its subwords; deal spreads them over tasks, those of equal texts too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, counts = Subwords(ranks_sent.value), Counter()
        names = ["word", "n", "window", "deal"]

        def flush() -> Iterator[pa.RecordBatch]:
            k = len(counts)
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int64())], names=names)
            counts.clear()

        def put(windows: list[bytes], deal: list[int]) -> pa.RecordBatch:
            k = len(windows)
            return pa.RecordBatch.from_arrays([pa.nulls(k, pa.binary()), pa.nulls(k, pa.int64()), pa.array(windows, pa.binary()), pa.array(deal, pa.int64())], names=names)

        for batch in batches:
            windows, deal = [], []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = (text or b"").lower().split()
                counts.update(words)
                counts[END_WORD] += 1
                new = cut(coder.many(words)[0], coder.size)
                windows += new
                deal += range(row, row + len(new))
                if len(windows) > 20_000:
                    yield put(windows, deal)
                    windows, deal = [], []
            yield put(windows, deal)
            if len(counts) > 150_000:
                yield from flush()
        yield from flush()

    return stage(docs.mapInArrow(run, "word binary, n long, window binary, deal long"), "tally")


def _as_windows(raw: list[bytes], classes: np.ndarray) -> np.ndarray:
    out = np.full((len(raw), att.CONTEXT + 1), -1, np.int64)
    length = np.array([len(r) // 2 for r in raw])
    out[np.arange(att.CONTEXT + 1) < length[:, None]] = classes[np.frombuffer(b"".join(raw), "<u2")]
    return out


class Model:
    """What scoring needs: classes, log probabilities of subwords within them, weights, pairs of subwords inside words."""

    def __init__(self, classes: np.ndarray, within: np.ndarray, weights: np.ndarray):
        self.classes, self.within, self.weights = classes, within, weights
        self.pairs, self.pair_n, self.sums, self.sum_n = (np.zeros(1, np.int64) for _ in range(4))

    def add_pairs(self, pairs: np.ndarray) -> None:
        """pairs: rows (subword, next subword, in how many words)."""
        if len(pairs):
            a, b, n = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))].T
            self.pairs, self.pair_n = a << 20 | b, n
            key = a << 20 | self.classes[b]
            order = np.argsort(key, kind="stable")
            self.sums, at = np.unique(key[order], return_index=True)
            self.sum_n = np.add.reduceat(n[order], at)

    def inside(self, ids: np.ndarray) -> np.ndarray:
        """Log probability of each subword within its class: given the one before it, backed off to its frequency."""
        p = self.within[ids].astype(np.float64)
        go = np.flatnonzero(self.classes[ids[1:]] >= att.STARTS) + 1
        go = go[self.classes[ids[go]] != att.END]
        a, b = ids[go - 1], ids[go]

        def look(keys: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            return np.where(keys[at] == key, n[at], 0)

        mine, all_ = look(self.pairs, self.pair_n, a << 20 | b), look(self.sums, self.sum_n, a << 20 | self.classes[b])
        p[go] = np.log((mine + BACK_OFF * np.exp(p[go])) / (all_ + BACK_OFF))
        return p


def counted_in(held: np.ndarray, total: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending keys and their counts, with new keys counted in: these are sorted alone, then two sorted runs are merged."""
    new, n = np.unique(new, return_counts=True)
    keys = np.concatenate([held, new])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], np.concatenate([total, n])[order]
    head = np.ones(len(keys), bool)
    head[1:] = keys[1:] != keys[:-1]
    head = np.flatnonzero(head)
    return keys[head], np.add.reduceat(n, head) if len(head) else n


def neighbours(windows: DataFrame, counts: np.ndarray) -> DataFrame:
    """Staged rows (id, at, n): what stands beside each subword in all windows, and how often.

    at numbers the 512 most frequent subwords after it, then those before it, so a row has no more than 1024 entries.
    """
    size = len(counts) - 1
    common = np.argsort(-counts[:size], kind="stable")[: att.COLUMNS]
    column = np.full(size + 1, -1)
    column[common] = np.arange(len(common))
    sent = windows.sparkSession.sparkContext.broadcast(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column = sent.value
        size, width = len(column) - 1, 2 * att.COLUMNS
        held, total, n_held = np.empty(0, np.int64), np.empty(0, np.int64), 0
        waiting: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held // width), pa.array((held % width).astype(np.int32)), pa.array(total)], names=["id", "at", "n"])

        for batch in batches:
            raw = batch.column(0).to_pylist()
            flat = np.frombuffer(b"".join(raw), "<u2").astype(np.int64)
            inside = np.ones(len(flat), bool)
            inside[np.cumsum([len(w) // 2 for w in raw]) - 1] = False
            k = np.flatnonzero(inside)
            for x, y, shift in ((flat[k], flat[k + 1], 0), (flat[k + 1], flat[k], att.COLUMNS)):
                ok = (x < size) & (column[y] >= 0)
                waiting.append(x[ok] * width + column[y[ok]] + shift)
                n_held += len(waiting[-1])
            if n_held > 250_000:
                held, total = counted_in(held, total, np.concatenate(waiting))
                waiting, n_held = [], 0
                if len(held) > 250_000:
                    yield out()
                    held, total = held[:0], total[:0]
        if waiting:
            held, total = counted_in(held, total, np.concatenate(waiting))
        yield out()

    pairs = windows.mapInArrow(run, "id long, at int, n long").groupBy("id", "at").agg(F.sum("n").alias("n"))
    rows = pairs.groupBy("id").agg(F.collect_list(F.struct("at", "n")).alias("r"))
    return stage(rows.select("id", F.col("r.at").alias("at"), F.col("r.n").alias("n")), "neighbours")


def classes_of(windows: DataFrame, counts: np.ndarray, begins: np.ndarray, rounds: int = 12) -> np.ndarray:
    """A class for each subword: those with like neighbours in all windows together (k-means), beginnings of words apart.

    Each round runs where the rows are, of which there are as many as subwords; only its sums come to the driver.
    """
    size = len(counts) - 1
    out = np.where(begins, att.STARTS - 1, att.STARTS + att.INSIDES - 1)
    rows = neighbours(windows, counts)
    order = np.argsort(-counts[:size], kind="stable")
    order = order[counts[order] > 0]
    kinds = [order[begins[order] == kind][:n] for kind, n in ((True, att.STARTS), (False, att.INSIDES))]
    firsts = [int(i) for kind in kinds for i in kind]
    if not firsts:
        return out
    # a class begins as one of the most frequent subwords of its kind
    centre = np.zeros((len(firsts), 2 * att.COLUMNS), np.float32)
    place = {i: k for k, i in enumerate(firsts)}
    for r in rows.where(F.col("id").isin(firsts)).collect():
        centre[place[r.id], r.at] = np.sqrt(np.array(r.n) / sum(r.n))
    n_starts, sc = len(kinds[0]), windows.sparkSession.sparkContext

    def nearest(batch: pa.RecordBatch, centre: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = batch.column(0).to_numpy()
        f = np.zeros((len(ids), centre.shape[1]), np.float32)
        for k, (at, n) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
            f[k, at] = n
        f = np.sqrt(f / np.maximum(1, f.sum(1, keepdims=True)))
        far = (centre * centre).sum(1) - 2 * f @ centre.T
        far[begins[ids][:, None] != (np.arange(len(centre)) < n_starts)] = np.inf
        return ids, f, far.argmin(1)

    for _ in range(rounds):
        sent = sc.broadcast((centre, begins, counts))

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centre, begins, counts = sent.value
            total, weight = np.zeros(centre.shape), np.zeros(len(centre))
            for batch in batches:
                ids, f, near = nearest(batch, centre, begins)
                np.add.at(total, near, f * counts[ids][:, None])
                weight += np.bincount(near, counts[ids], len(centre))
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([weight.tobytes()], pa.binary())], names=["total", "weight"])

        parts = rows.coalesce(16).mapInArrow(sums, "total binary, weight binary").collect()
        total = sum((np.frombuffer(p.total).reshape(centre.shape) for p in parts), np.zeros(centre.shape))
        weight = sum((np.frombuffer(p.weight) for p in parts), np.zeros(len(centre)))
        centre = np.where(weight[:, None] > 0, total / np.maximum(weight, 1e-9)[:, None], centre).astype(np.float32)
    sent = sc.broadcast((centre, begins))

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, _, near = nearest(batch, *sent.value)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(near)], names=["id", "near"])

    for r in rows.mapInArrow(last, "id long, near long").collect():
        out[r.id] = r.near if r.near < n_starts else r.near - n_starts + att.STARTS
    discard(rows)
    return out


def fit(windows: DataFrame, coder: Subwords) -> Model:
    """Trains on all windows: tasks train on their windows from common weights, which are then averaged, in rounds. The last round has all windows.

    Classes and frequencies are those of all windows.
    """
    sc = windows.sparkSession.sparkContext

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(coder_size + 1, np.int64)
        for batch in batches:
            # a window's first subword is the target of the window before it
            n += np.bincount(np.frombuffer(b"".join(w[2:] for w in batch.column(0).to_pylist()), "<u2"), minlength=len(n))
        ids = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n[ids])], names=["id", "n"])

    coder_size, counts = coder.size, np.zeros(coder.size + 1)
    for r in windows.mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r.id] = r.n
    classes = np.append(classes_of(windows, counts, coder.begins), att.END)
    smooth = counts + 0.05
    smooth[-1] = max(counts[-1], 1.0)
    within = np.log(smooth / np.bincount(classes, smooth)[classes]).astype(np.float32)
    weights = att.initial(np.bincount(classes, counts, minlength=att.CLASSES))
    n_windows = windows.count()
    for r, one_in in enumerate(ROUNDS):
        tasks = max(1, -(-n_windows // (PER_TASK * one_in)))
        rows = windows.where(F.pmod(F.xxhash64("deal", "window", F.lit(3)), F.lit(one_in)) == 0)
        sent = sc.broadcast((weights, classes))

        def learn(batches: Iterator[pa.RecordBatch], r: int = r) -> Iterator[pa.RecordBatch]:
            weights, classes = sent.value
            raw = [w for batch in batches for w in batch.column(0).to_pylist()]
            if raw:
                rows = _as_windows(raw, classes)
                done = att.train(weights, rows, STEPS, rate=0.01 / (1 + 2 * r), seed=r).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([(done * len(raw)).tobytes()], pa.binary()), pa.array([len(raw)], pa.int64())], names=["sum", "n"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = None, 0
            for batch in batches:
                for s, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    total, n = np.frombuffer(s) + (0 if total is None else total), n + k
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["sum", "n"])

        dealt = rows.repartition(tasks, F.xxhash64("window", "deal")).mapInArrow(learn, "sum binary, n long")
        parts = (dealt.repartition(16) if tasks > 16 else dealt).mapInArrow(add, "sum binary, n long").collect()
        if parts:
            weights = (sum(np.frombuffer(p["sum"]) for p in parts) / sum(p.n for p in parts)).astype(np.float32)
    return Model(classes, within, weights)


class Scorer:
    """Scores texts, and says which of their words the lexicon lacks."""

    MOST = 100_000

    def __init__(self, ranks: dict[bytes, int], words: list[bytes], counts: np.ndarray, total: int, missed: dict[int, int], model: Model):
        self.coder, self.model, self.w = Subwords(ranks), model, att.unpack(model.weights)
        self.starts = np.zeros(att.CLASSES, bool)
        self.starts[: att.STARTS] = self.starts[att.END] = True
        self.n_words = len(words)
        self.log_count = np.log10(counts + 1.0)
        self.words = words
        self.base_ids, self.base_size = self.coder.many(words)
        first = self.base_ids[np.cumsum(self.base_size) - self.base_size]
        inside, outside = np.bincount(first, counts, minlength=self.coder.size), np.zeros(self.coder.size)
        outside[list(missed)] = list(missed.values())
        self.escape = np.log((outside + 0.5) / (inside + outside + 1))
        self.lexical = np.log(np.maximum(counts, 1) / np.maximum(inside[first], 1)) + np.log1p(-np.exp(self.escape[first]))
        self.plain = np.log(np.maximum(counts, 1) / max(1, total))
        self.reset()

    def reset(self) -> None:
        self.number = dict(zip(self.words, range(self.n_words)))
        self.ids, self.size = [self.base_ids], [self.base_size]

    def learn(self, words: list[bytes]) -> None:
        ids, size = self.coder.many(words)
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words))))
        self.ids.append(ids)
        self.size.append(size)

    def number_sizes(self) -> np.ndarray:
        if len(self.size) > 1:
            self.size, self.ids = [np.concatenate(self.size)], [np.concatenate(self.ids)]
        return self.size[0]

    def run(self, texts: list[bytes]) -> Iterator[tuple]:
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size < 1 << 19):
                size += len(texts[hi])
                hi += 1
            yield from self._block(texts[lo:hi])
            lo = hi

    def _block(self, texts: list[bytes]) -> Iterator[tuple]:
        """Per text: words with end, known ones, sum of log10(count + 1) over the lexicon's, score without the words
        it lacks, and these with the model's log10 probability."""
        split = [t.lower().split() for t in texts]
        new = set().union(*split).difference(self.number)
        if len(self.number) + len(new) > self.n_words + self.MOST:
            self.reset()
            new = set().union(*split).difference(self.number)
        self.learn(list(new))
        sizes, all_ids = self.number_sizes(), self.ids[0]
        offset = np.cumsum(sizes) - sizes
        n = np.array([len(s) for s in split])
        number = np.fromiter(map(self.number.__getitem__, chain.from_iterable(split)), np.int64, int(n.sum()))
        text = np.repeat(np.arange(len(split)), n)
        hot = number < self.n_words
        log_count, lexical, plain = np.zeros(len(number)), np.full(len(number), -np.inf), np.full(len(number), -np.inf)
        log_count[hot], lexical[hot], plain[hot] = self.log_count[number[hot]], self.lexical[number[hot]], self.plain[number[hot]]
        # subwords of all texts in a row, each text followed by its end
        k = sizes[number]
        per_text = np.bincount(text, k, minlength=len(split)).astype(np.int64) + 1
        first = np.concatenate([[0], np.cumsum(per_text)])
        at = np.cumsum(k) - k + text  # where each word's subwords begin
        ids = np.full(first[-1], self.coder.size, np.int64)
        inner = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
        ids[np.repeat(at, k) + inner] = all_ids[np.repeat(offset[number], k) + inner]
        p, begin = att.log_probabilities(self.w, self.model.classes[ids], first, self.starts)
        p = p + self.model.inside(ids)
        begin = np.minimum(begin.astype(np.float64), 0)
        total = np.concatenate([[0], np.cumsum(p)])
        # a word: its first subword given that a word begins; then the lexicon, or the rest and another beginning
        end, head = at + k, p[at] - begin[at]
        rest = total[end] - total[at + 1] + begin[end]
        mixed = head + np.logaddexp(rest + self.escape[all_ids[offset[number]]], lexical)
        mixed = np.logaddexp(mixed + math.log(1 - PLAIN), plain + math.log(PLAIN))
        last = first[1:] - 1
        # words outside the lexicon wait for their counts
        score = (np.bincount(text, np.where(hot, mixed, 0.0), minlength=len(split)) + p[last] - begin[last]) / math.log(10)
        own = (mixed / math.log(10)).tolist()
        sums = np.bincount(text, log_count, minlength=len(split))
        known = np.bincount(text, hot, minlength=len(split)).astype(np.int64)
        edges = np.concatenate([[0], np.cumsum(n)])
        for i, words in enumerate(split):
            rare = np.flatnonzero(~hot[edges[i] : edges[i + 1]])
            yield int(n[i]) + 1, int(known[i]), float(sums[i]), float(score[i]), [{"word": words[j], "own": own[edges[i] + j]} for j in rare.tolist()]


def word_figures(counts: DataFrame, words: list[bytes], ranks_sent) -> tuple[dict[int, int], np.ndarray]:
    """By first subword, how many training words are not in the lexicon; and pairs of subwords inside words, by distinct words.

    Both are counted over all distinct training words. Every pair met in more than one of them is kept, three numbers each;
    the vocabulary bounds how many there can be. One word alone tells no pair: there the model backs off.
    """
    sent = counts.sparkSession.sparkContext.broadcast(frozenset(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Subwords(ranks_sent.value)
        total = np.zeros(coder.size, np.int64)
        for batch in batches:
            rest = [(w, k) for w, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if w != END_WORD]
            if rest:
                ids, sizes = coder.many([w for w, _ in rest])
                at = np.cumsum(sizes) - sizes
                rare = np.array([w not in sent.value for w, _ in rest])
                np.add.at(total, ids[at[rare]], np.array([k for _, k in rest])[rare])
                inner = np.ones(len(ids), bool)
                inner[at] = False
                go = np.flatnonzero(inner)
                key, n = np.unique(ids[go - 1] << 20 | ids[go], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key >> 20), pa.array(key & (1 << 20) - 1), pa.array(n.astype(np.int64))], names=["a", "b", "n"])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.nulls(len(at), pa.int64()), pa.array(total[at])], names=["a", "b", "n"])

    rows = stage(counts.mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")), "figures")
    first = {r.a: r.n for r in rows.where("b is null").collect()}
    found = rows.where("b is not null and n > 1").select("a", "b", "n").toArrow()
    pairs = np.column_stack([found.column(k).to_numpy().astype(np.int64) for k in range(3)])
    discard(rows)
    return first, pairs


def score(docs: DataFrame, folds: int = 7, held: int = 2, vocabulary: dict[bytes, int] | None = None) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one for each row of docs.

    Null texts count as empty: one token, the end. Null doc_ids are in no fold, so they train. Repeated rows are
    counted each time and get equal scores; other columns are ignored; an empty table gives an empty one; without
    training texts all counts are 0.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    ranks = sc.broadcast(vocabulary or public_ranks())
    held_out = fold(F.col("doc_id"), folds) == held
    texts = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", held_out.alias("held_out"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    tally = _tally(texts.where(~F.col("held_out")).select("row", "text"), ranks)
    counts = stage(tally.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).collect()[0]
    often = counts.where((F.col("n") > 1) & (F.col("n") * (16 * LEXICON) >= total) & (F.col("word") != F.lit(END_WORD)))
    often = often.orderBy(F.desc("n"), "word").limit(LEXICON).collect()
    model = fit(tally.where("window is not null").select("window", "deal"), Subwords(ranks.value))
    discard(tally)
    words, n = [bytes(r.word) for r in often], np.array([r.n for r in often], float)
    end_count = sum(r.n for r in counts.where(F.col("word") == F.lit(END_WORD)).collect())
    missed, pairs = word_figures(counts, words, ranks)
    model.add_pairs(pairs)
    sent = sc.broadcast((words, n, total, missed, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(ranks.value, *sent.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                cols = list(zip(*scorer.run(part.column("text").to_pylist())))
                types = pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.struct([("word", pa.binary()), ("own", pa.float64())]))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *(pa.array(c, t) for c, t in zip(cols, types))],
                                                 names=["row", "doc_id", "held_out", "n_tokens", "known", "sums", "score", "rare"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = stage(texts.mapInArrow(run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, sums double, score double, rare array<struct<word:binary,own:double>>"), "scored")
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.own").join(counts, "word", "left")
    # a word that training has: its frequency is mixed in, as for the lexicon's
    own = F.when(F.col("n").isNull(), F.col("own")).otherwise(F.log10(F.pow(F.lit(10.0), F.col("own")) + PLAIN * F.col("n") / F.lit(float(max(1, total)))))
    rare = rare.groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("more"), F.count("n").alias("more_known"), F.sum(own).alias("more_score"))
    out = scored.drop("rare").join(rare, "row", "left")
    whole = math.log10(total + kinds + 1)
    base = F.col("sums") + F.coalesce("more", F.lit(0.0)) + math.log10(end_count + 1) - F.col("n_tokens") * whole
    known = F.col("known") + F.coalesce("more_known", F.lit(0)) + int(end_count > 0)
    return out.select("doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"))


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir).select("doc_id", "text"))
