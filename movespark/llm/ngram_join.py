"""N-gram Jaccard join by parity sketches, and near-duplicate groups of documents.

A document is the set of its distinct five-word shingles, each hashed to 64 bits. Dealing the shingles to
segments and XOR-ing what falls into one gives a parity sketch: a differing shingle changes one segment, so the
number of differing segments is at most the symmetric difference D. Documents of similar size that link differ
in at most (|A| + |B|) / 7 shingles. If both send the first D + 1 of their filled segments, in the order of
the segments, a pair that links shares one (pigeonhole): candidates meet by an equi-join on segment values,
one table for each size band and one for each border between bands. A second sketch of single bits,
about one for each shingle, drops candidates whose Hamming distance exceeds the bound; the rest is verified exactly.

Frequent shingles are left out of the first level, which keeps passages that many documents share from making
candidates: leaving out the same shingles everywhere only lessens D. A document that then fills
too few segments takes part in the next level too, with all its shingles, and then in finer ones, until it
fills enough. A pair meets at the first level at which one of the two does. So no link is lost.

Groups of equal segment values with SMALL members at most pair them; large groups are joined in trees by task instead.
Where members of a large group end up in different components after that, what shares such groups is brought
together: first sketches are compared, piece by piece, and what they can't rule out falls into small groups. Only
these bring their sets and are compared exactly across components, telling only a spanning forest of the links. Exact copies of a set are one node from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Forest, components, discard, documents, in_pieces, lean, runs, stage
from .textblock import Block, blocks, mixed

#: Words of a shingle; link if UNION_PART * intersection >= PART * union.
SHINGLE, PART, WHOLE = 5, 75, 100
#: Shingles met this often in a block of texts are counted over the corpus; the most frequent of them are set apart.
IN_BLOCK, FREQUENT, MOST_FREQUENT = 4, 16, 1 << 18
#: So are those in this many of the sets that are sampled, one in SAMPLE: however rare they are in a block.
SAMPLED, SAMPLE = 3, 16
LEVELS = 4
#: Members of the largest groups of equal segment values that are paired; documents compared with one another in a piece of work.
SMALL, PIECE = 8, 1024
U = np.uint64


class Sets:
    """Shingle sets of a block's texts: tokens by text, ascending; n, first and fingerprint of each text."""

    def __init__(self, b: Block):
        h = b.word_hashes()
        tokens, at = b.windows(h, SHINGLE)
        text = np.repeat(np.arange(len(b.n_words)), b.n_words)
        of = text[at] if len(at) else np.empty(0, np.int64)
        short = np.flatnonzero((b.n_words > 0) & (b.n_words < SHINGLE))
        if len(short):
            whole = [mixed(np.add.reduce(h[b.first[k] : b.first[k + 1]] * (np.arange(1, b.n_words[k] + 1, dtype=U) * U(2) + U(1)), keepdims=True) + U(b.n_words[k]))[0] for k in short]
            tokens, of = np.concatenate([tokens, np.array(whole, U)]), np.concatenate([of, short])
        order = np.lexsort((tokens, of))
        tokens, of = tokens[order], of[order]
        fresh = np.ones(len(tokens), bool)
        fresh[1:] = (tokens[1:] != tokens[:-1]) | (of[1:] != of[:-1])
        self.tokens, self.of = tokens[fresh], of[fresh]
        self.n = np.bincount(self.of, minlength=len(b.n_words))
        self.first = np.concatenate([[0], np.cumsum(self.n)])
        total = np.concatenate([np.zeros(1, U), np.cumsum(mixed(self.tokens ^ U(0x5851F42D4C957F2D)), dtype=U)])
        again = np.concatenate([np.zeros(1, U), np.cumsum(mixed(self.tokens + U(0x14057B7EF767814F)), dtype=U)])
        a, z = self.first[:-1], self.first[1:]
        self.print = mixed(mixed(total[z] - total[a]) + (again[z] - again[a]) * U(3) + self.n.astype(U)).view(np.int64)

    def sketches(self) -> list[bytes]:
        """Parity of single bits: a power of two, at least the set's size and 64, of them."""
        bits = 1 << np.maximum(6, np.ceil(np.log2(np.maximum(self.n, 1))).astype(np.int64))
        start = np.concatenate([[0], np.cumsum(bits)])
        where = start[:-1][self.of] + (self.tokens >> U(7)).astype(np.int64) % bits[self.of]
        packed = np.packbits(np.bincount(where, minlength=start[-1]).astype(np.uint8) & 1, bitorder="little").tobytes()
        return [packed[a // 8 : z // 8] for a, z in zip(start[:-1].tolist(), start[1:].tolist())]


def tables(n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For sizes n: which take part in the own-band and the border tables, with table, segments and bound D."""
    band = np.floor(np.log2(np.maximum(n, 1))).astype(np.int64)
    low, high, partner = 1 << band, 2 << band, 4 * n // 3
    yield n > 0, 2 * band, np.ceil(0.32 * high).astype(np.int64) + 3, (n + np.minimum(high - 1, partner)) // 7
    under, over = 4 * n >= 3 * high, 3 * n <= 4 * (low - 1)
    border = np.where(under, band + 1, band)
    bound = np.where(under, n + partner, n + low - 1) // 7
    yield (n > 0) & (under | over), 2 * border + 1, np.ceil(0.36 * (1 << border)).astype(np.int64) + 3, bound


def segment_keys(s: Sets, frequent: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the chosen texts' first segments at all levels they take part in, and the text of each."""
    out_key, out_of = [], []
    rare = np.ones(len(s.tokens), bool)
    if len(frequent):
        rare = frequent[np.minimum(np.searchsorted(frequent, s.tokens), len(frequent) - 1)] != s.tokens
    for member, table, segments, bound in tables(s.n):
        open_ = member & chosen
        for level in range(LEVELS):
            use = open_[s.of] & (rare if level == 0 else True)
            tokens, of = s.tokens[use], s.of[use]
            salt = mixed((table * 8 + level).astype(U) + U(0x9E3779B97F4A7C15))[of]
            many = segments if level < 2 else segments * 8 if level == 2 else np.full_like(segments, 1 << 40)
            segment = (mixed(tokens ^ salt) >> U(20)).astype(np.int64) % many[of]
            order = np.lexsort((segment, of))
            tokens, of, segment, salt = tokens[order], of[order], segment[order], salt[order]
            head = np.ones(len(of), bool)
            head[1:] = (of[1:] != of[:-1]) | (segment[1:] != segment[:-1])
            head = np.flatnonzero(head)
            if len(head):
                value = np.bitwise_xor.reduceat(tokens, head)
                of, segment, salt = of[head], segment[head], salt[head]
                filled = np.bincount(of, minlength=len(s.n))
                rank = np.arange(len(of)) - (np.cumsum(filled) - filled)[of]
                send = rank <= bound[of]
                out_key.append(mixed(value ^ mixed(segment.astype(U) + salt))[send].view(np.int64))
                out_of.append(of[send])
            else:
                filled = np.zeros(len(s.n), np.int64)
            open_ = open_ & (filled <= bound)
            if not open_.any():
                break
    if not out_key:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(out_key), np.concatenate(out_of)


def _text_blocks(batch: pa.RecordBatch) -> Iterator[tuple[Block, Sets]]:
    for b in blocks(batch.column(batch.num_columns - 1), lower=True):
        yield b, Sets(b)


def _rows(names: list[str], *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(cols), names=names)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """Staged rows (doc_id, n, print, sketch, tokens) of documents, tokens of sampled ones only, and (token, times) of shingles frequent in a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "print", "sketch", "tokens", "token", "times"]
        for batch in batches:
            for b, s in _text_blocks(batch):
                k = len(s.n)
                sampled = ((s.n > 0) & (s.print % SAMPLE == 0)).tolist()
                tokens = pa.array([s.tokens[a:z].tobytes() if x else None for x, a, z in zip(sampled, s.first[:-1].tolist(), s.first[1:].tolist())], pa.binary())
                yield _rows(names, batch.column(0).slice(b.lo, k), pa.array(s.n), pa.array(s.print), pa.array(s.sketches(), pa.binary()), tokens, pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()))
                token, times = np.unique(s.tokens, return_counts=True)
                token, times = token[times >= IN_BLOCK].view(np.int64), times[times >= IN_BLOCK]
                k = len(token)
                yield _rows(names, *(pa.nulls(k, t) for t in (batch.schema.field(0).type, pa.int64(), pa.int64(), pa.binary(), pa.binary())), pa.array(token), pa.array(times.astype(np.int64)))

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return stage(texts.mapInArrow(lean(run), f"doc_id {kind}, n long, print long, sketch binary, tokens binary, token long, times long"), "sets")


def frequent_shingles(sets: DataFrame) -> np.ndarray:
    """Up to MOST_FREQUENT shingles that are frequent in the corpus. Which ones decides on speed, not on results."""


    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token, times = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64), return_counts=True)
            yield _rows(["token", "t"], pa.array(token), pa.array(times.astype(np.int64)))

    total = sets.where("token is not null").groupBy("token").agg(F.sum("times").alias("t")).where(F.col("t") >= FREQUENT)
    # equal sets count once
    sample = sets.where("tokens is not null").select("print", "tokens").dropDuplicates(["print"]).select("tokens")
    spread = sample.mapInArrow(lean(count), "token long, t long").groupBy("token").agg(F.sum("t").alias("t")).where(F.col("t") >= SAMPLED)
    total = total.unionByName(spread.withColumn("t", F.col("t") * SAMPLE)).groupBy("token").agg(F.max("t").alias("t"))
    # staged, so that the shuffle files of the counts go before keys are dealt
    rows = stage(total.orderBy(F.desc("t"), "token").limit(MOST_FREQUENT).select("token"), "frequent").toArrow()
    return np.sort(rows.column(0).to_numpy().astype(np.int64).view(U)) if rows.num_rows else np.empty(0, U)


def _fold(x: int, bits: int, to: int) -> int:
    while bits > to:
        bits //= 2
        x = (x >> bits) ^ (x & ((1 << bits) - 1))
    return x


def may_link(n: int, m: int, x: bytes, y: bytes) -> bool:
    """False if sizes or the Hamming distance of parity sketches rule a link out."""
    if 4 * n < 3 * m or 4 * m < 3 * n:
        return False
    bits = 8 * min(len(x), len(y))
    a, b = _fold(int.from_bytes(x, "little"), 8 * len(x), bits), _fold(int.from_bytes(y, "little"), 8 * len(y), bits)
    return (a ^ b).bit_count() <= (n + m) // 7


def candidates(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """Staged rows (a, b) of pairs to verify, and (key, a) of the members of large groups.

    Pairs are those of each small group, (SMALL - 1) / 2 for each member at most, and (smallest, other) of each tree into
    which a task's large groups fall.
    """
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, s in _text_blocks(batch):
                chosen = np.zeros(len(s.n), bool)
                for k, p in enumerate(s.print.tolist()):
                    if p not in seen:
                        seen.add(p)
                        chosen[k] = True
                key, of = segment_keys(s, sent.value, chosen)
                yield _rows(["key", "print"], pa.array(key), pa.array(s.print[of]))

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left_key, left_print, trees = np.empty(0, np.int64), np.empty(0, np.int64), Forest()

        def groups(key: np.ndarray, who: np.ndarray) -> Iterator[pa.RecordBatch]:
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (who[1:] != who[:-1])
            key, who = key[fresh], who[fresh]
            head = np.ones(len(key), bool)
            head[1:] = key[1:] != key[:-1]
            start = np.flatnonzero(head)
            size = np.diff(np.append(start, len(key)))
            pairs = [np.empty((0, 2), np.int64)]
            for n in range(2, SMALL + 1):
                members = who[start[size == n][:, None] + np.arange(n)]
                pairs += [members[:, [i, j]] for j in range(n) for i in range(j)]
            two = np.unique(np.concatenate(pairs), axis=0)
            yield _rows(["key", "a", "b"], pa.nulls(len(two), pa.int64()), pa.array(two[:, 0]), pa.array(two[:, 1]))
            large = np.repeat(size > SMALL, size)
            first = np.repeat(who[start], size)
            for a, b in zip(first[large].tolist(), who[large].tolist()):
                trees.merge(a, b)
            yield _rows(["key", "a", "b"], pa.array(key[large]), pa.array(who[large]), pa.nulls(int(large.sum()), pa.int64()))

        for batch in batches:
            key = np.concatenate([left_key, batch.column(0).to_numpy()])
            who = np.concatenate([left_print, batch.column(1).to_numpy()])
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
            left_key, left_print = key[cut:], who[cut:]
            if cut:
                yield from groups(key[:cut], who[:cut])
        if len(left_key):
            yield from groups(left_key, left_print)
        a, b = trees.stars()
        yield _rows(["key", "a", "b"], pa.nulls(len(a), pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()))

    texts = docs.select(F.col("text").cast("binary").alias("text"))
    keys = texts.mapInArrow(lean(emit), "key long, print long")
    sorted_ = keys.repartition("key").sortWithinPartitions("key", "print")
    return stage(sorted_.mapInArrow(lean(pair), "key long, a long, b long"), "candidates")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Staged rows (print, tokens) of the sets whose prints are wanted, made again from the texts."""
    # a filter of bounded size; beyond it every set is made and the join alone picks what is wanted
    few = np.sort(wanted.toArrow().column(0).to_numpy()) if wanted.count() <= 2_000_000 else None
    sent = docs.sparkSession.sparkContext.broadcast(few)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few, seen = sent.value, set()
        for batch in batches:
            for _, s in _text_blocks(batch):
                take = s.n > 0
                if few is not None:
                    take &= few[np.minimum(np.searchsorted(few, s.print), len(few) - 1)] == s.print
                hit = []
                for k in np.flatnonzero(take).tolist():
                    if (p := int(s.print[k])) not in seen:
                        seen.add(p)
                        hit.append(k)
                yield _rows(["print", "tokens"], pa.array(s.print[hit]), pa.array([s.tokens[s.first[k] : s.first[k + 1]].tobytes() for k in hit], pa.binary()))

    texts = docs.select(F.col("text").cast("binary").alias("text"))
    return stage(texts.mapInArrow(lean(run), "print long, tokens binary").dropDuplicates(["print"]), "tokens")


def verified(docs: DataFrame, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Staged pairs (a, b) that link: sketches first, then exact intersections of recomputed sets."""

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [may_link(*row) for row in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "xa", "xb")))]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left = nodes.select(F.col("print").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("xa"))
    right = nodes.select(F.col("print").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("xb"))
    # nothing bounds sketches and sets: they are merged, never broadcast
    close = stage(pairs.distinct().join(left.hint("merge"), "a").join(right.hint("merge"), "b").mapInArrow(lean(sift), "a long, b long"), "close")
    wanted = stage(close.select(F.col("a").alias("print")).union(close.select("b")).distinct(), "wanted")
    if wanted.isEmpty():
        return close
    sets = sets_of(docs, wanted)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist()):
                x, y = np.frombuffer(x, U), np.frombuffer(y, U)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                ok.append(WHOLE * common >= PART * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    with_a = close.join(sets.select(F.col("print").alias("a"), F.col("tokens").alias("ta")).hint("merge"), "a")
    with_both = with_a.join(sets.select(F.col("print").alias("b"), F.col("tokens").alias("tb")).hint("merge"), "b")
    links = stage(with_both.select("a", "b", "ta", "tb").mapInArrow(lean(exact), "a long, b long"), "verified")
    discard(sets)
    return links


def likely(node: np.ndarray, comp: np.ndarray, n: np.ndarray, sketches: list[bytes], drive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (smallest, other) of trees over the nodes that may link across components, by the test of may_link of each driving node with all."""
    label, width = np.arange(len(node)), np.array([len(x) for x in sketches])
    groups = {}
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        raw = np.frombuffer(b"".join(sketches[k] for k in at.tolist()), np.uint8).reshape(len(at), w)
        groups[w] = at, raw, raw[:, : w // 2] ^ raw[:, w // 2 :]
    place = np.zeros(len(node), np.int64)
    for at, _, _ in groups.values():
        place[at] = np.arange(len(at))

    def words(rows: np.ndarray) -> np.ndarray:
        rows = np.ascontiguousarray(rows)
        return rows.view(U if rows.shape[-1] % 8 == 0 else np.uint8)

    packed = {w: (at, words(raw), words(half)) for w, (at, raw, half) in groups.items()}
    for x in drive.tolist():
        w, k = int(width[x]), int(place[x])
        # sizes that may link have sketches of one width, or of twice or half of it
        for other, mine, theirs in ((w, 1, 1), (2 * w, 1, 2), (w // 2, 2, 1)):
            if other not in packed:
                continue
            at, rows = packed[other][0], packed[other][theirs]
            apart = np.bitwise_count(rows ^ packed[w][mine][k]).sum(1, dtype=np.int64)
            m = n[at]
            hit = (apart <= (m + n[x]) // 7) & (4 * m >= 3 * n[x]) & (4 * n[x] >= 3 * m) & (comp[at] != comp[x])
            merged = np.unique(label[at[hit]])
            if len(merged) > 1 or len(merged) and merged[0] != label[x]:
                label[np.isin(label, merged)] = label[x]
    order = np.lexsort((node, label))
    head = np.ones(len(order), bool)
    head[1:] = label[order][1:] != label[order][:-1]
    least = node[order][np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    return least[~head], node[order][~head]


def across(docs: DataFrame, found: DataFrame, comps: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) that link components whose members share a key: a spanning forest of them."""
    members = found.where("key is not null").select("key", F.col("a").alias("node"))
    members = members.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_keys = members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    members = stage(members.join(open_keys, "key"), "members")

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, key, root = Forest(), None, 0
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != key:
                    key, root = k, c
                else:
                    forest.merge(root, c)
        a, b = forest.stars()
        yield _rows(["a", "b"], pa.array(a, pa.int64()), pa.array(b, pa.int64()))

    keyed = members.select("key", "component").repartition("key").sortWithinPartitions("key")
    near = components(keyed.mapInArrow(trees, "a long, b long")).select(F.col("node").alias("component"), F.col("component").alias("of"))
    who = stage(members.select("node", "component").distinct().join(near, "component"), "who")
    if who.isEmpty():
        return who.select(F.col("node").alias("a"), F.col("component").alias("b"))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, ["of", "i", "j"]):
            node, comp, n, mine = (run.column(c).to_numpy() for c in ("node", "component", "n", "mine"))
            drive = np.arange(len(node)) if run.column("i")[0].as_py() == run.column("j")[0].as_py() else np.flatnonzero(mine == run.column("i")[0].as_py())
            a, b = likely(node, comp, n, run.column("sketch").to_pylist(), drive)
            yield _rows(["a", "b"], pa.array(a), pa.array(b))

    small = in_pieces(who, "of", PIECE).join(nodes.select(F.col("print").alias("node"), "n", "sketch").hint("merge"), "node")
    small = small.select("of", "i", "j", "mine", "node", "component", "n", "sketch").repartition("of", "i", "j").sortWithinPartitions("of", "i", "j")
    close = components(small.mapInArrow(lean(sift), "a long, b long")).withColumnRenamed("component", "of")
    who = stage(who.drop("of").join(close, "node"), "close")
    if who.isEmpty():
        return who.select(F.col("node").alias("a"), F.col("component").alias("b"))
    sets = sets_of(docs, who.select(F.col("node").alias("print")))
    rows = in_pieces(who, "of", PIECE).join(sets.withColumnRenamed("print", "node").hint("merge"), "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, ["of", "i", "j"]):
            if run.num_rows < 2:
                continue
            node, comp, mine = (run.column(c).to_numpy() for c in ("node", "component", "mine"))
            tokens = [np.frombuffer(t, U) for t in run.column("tokens").to_pylist()]
            size = np.array([len(t) for t in tokens])
            _, ids = np.unique(np.concatenate(tokens), return_inverse=True)
            start = np.cumsum(size) - size
            mark = np.zeros(int(ids.max()) + 1, bool)
            forest, a, b = Forest(), [], []
            root = comp.copy()
            drive = np.arange(len(node)) if run.column("i")[0].as_py() == run.column("j")[0].as_py() else np.flatnonzero(mine == run.column("i")[0].as_py())
            for x in drive.tolist():
                if (root == root[x]).all():
                    break
                own = ids[start[x] : start[x] + size[x]]
                mark[own] = True
                common = np.add.reduceat(mark[ids], start, dtype=np.int64)
                mark[own] = False
                hit = (WHOLE * common >= PART * (size[x] + size - common)) & (root != root[x])
                for y in np.flatnonzero(hit).tolist():
                    if forest.merge(int(root[x]), int(root[y])):
                        a.append(int(node[x]))
                        b.append(int(node[y]))
                if hit.any():
                    root = np.array([forest.root(c) for c in comp.tolist()])
            yield _rows(["a", "b"], pa.array(a, pa.int64()), pa.array(b, pa.int64()))

    dealt = rows.select("of", "i", "j", "mine", "node", "component", "tokens").repartition("of", "i", "j").sortWithinPartitions("of", "i", "j")
    return dealt.mapInArrow(lean(compare), "a long, b long")


def jaccard_groups(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one for each row of docs; component_id is the smallest doc_id of the group.

    Null and empty texts, and texts without words, have empty sets, link with nothing and are their own
    component. Rows whose sets are equal link, repeated rows too. Null doc_ids stay null; they count for a
    component's id only if it has no other. Other columns of docs are ignored; an empty table gives an empty one.
    """
    sets = shingle_sets(docs)
    of_docs = sets.where("token is null").select("doc_id", "n", "print", "sketch")
    nodes = stage(of_docs.where("n > 0").groupBy("print").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "nodes")
    found = candidates(docs, frequent_shingles(sets))
    links = verified(docs, found.where("b is not null").select("a", "b"), nodes)
    comps = stage(components(links), "components")
    more = stage(across(docs, found, comps, nodes), "more")
    if not more.isEmpty():
        comps = stage(components(links.union(more)), "components")
    discard(found)
    group = nodes.join(comps.withColumnRenamed("node", "print"), "print", "left").select("print", "rep", F.coalesce("component", "print").alias("component"))
    least = group.groupBy("component").agg(F.min("rep").alias("component_id"))
    ids = stage(group.join(least, "component").select("print", "component_id"), "ids")
    full = of_docs.where("n > 0").join(ids, "print").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(of_docs.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents with one row of each group of near duplicates: the first by doc_id and text. Nulls and empty texts stay.

    Rows are told apart by doc_id and text, so an id may come with several texts, of one group or of several.
    """
    keyed = docs.withColumn("__k", F.xxhash64("doc_id", "text"))
    groups = jaccard_groups(keyed.select(F.col("__k").alias("doc_id"), "text")).where("n_shingles > 0")
    of = stage(groups.groupBy(F.col("doc_id").alias("__k"), "component_id").agg(F.count("*").alias("times")), "of")
    # rows that are alone in their group stay whatever their id
    shared = of.join(of.groupBy("component_id").agg(F.sum("times").alias("rows")).where("rows > 1"), "component_id")
    named = stage(shared.join(keyed.where("doc_id is not null").select("__k", "doc_id").distinct(), "__k"), "named")
    least = named.groupBy("component_id").agg(F.min("doc_id").alias("doc_id"))
    first = stage(named.join(least, ["component_id", "doc_id"]).select("component_id", "__k"), "first")
    tied = first.groupBy("component_id").count().where("count > 1").select("component_id")
    if not tied.isEmpty():
        texts = keyed.select("__k", "text").join(first.join(tied, "component_id", "left_semi"), "__k")
        chosen = texts.groupBy("component_id").agg(F.min_by("__k", "text").alias("__k"))
        first = stage(first.join(tied, "component_id", "left_anti").unionByName(chosen), "first")
    out = named.select("__k").join(first.select("__k"), "__k", "left_anti")
    left = keyed.join(out, "__k", "left_anti")
    twice = named.where("times > 1").select("__k")
    if twice.isEmpty():
        return left.select(*docs.columns)
    twice = stage(twice, "twice")
    once = left.join(twice, "__k", "left_semi").withColumn("__n", F.row_number().over(W.partitionBy("__k").orderBy("text"))).where("__n = 1")
    return left.join(twice, "__k", "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(documents(spark, sf_dir).select("doc_id", "text"))
