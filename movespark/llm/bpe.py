"""BPE encoding and decoding with a memory-mapped lexicon of frequent words.

The lexicon is a minimal acyclic transducer: frequent words share prefixes and suffixes in one automaton whose
arcs carry numbers that add up to a word's rank, and the rank leads to the word's ids. Words that it doesn't
hold are merged exactly by rank. A text's result never depends on which words the lexicon holds.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, documents, lean, stage

MAGIC = b"MADT0001"
#: Longer pieces are merged one by one; NONE is above every rank.
LONG, NONE = 256, 1 << 30


def public_vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# ---------------------------------------------------------------- transducer


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The file of a minimal acyclic transducer for these words, built in one pass over them in sorted order."""
    register: dict[tuple, int] = {}
    nodes: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    counts: list[int] = []

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(nodes)
            nodes.append(key)
            counts.append(int(node[0]) + sum(counts[q] for _, q in node[1]))
        return register[key]

    words = sorted(w for w in entries if w)
    path: list[list] = [[False, []]]  # open states on the path of the last word
    last = b""
    for word in words:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        while len(path) > common + 1:
            done = freeze(path.pop())
            path[-1][1].append((last[len(path) - 1], done))
        for _ in word[common:]:
            path.append([False, []])
        path[-1][0] = True
        last = word
    while len(path) > 1:
        done = freeze(path.pop())
        path[-1][1].append((last[len(path) - 1], done))
    root = freeze(path[0])
    keys, to, skip = [], [], []
    for q, (final, arcs) in enumerate(nodes):
        before = int(final)
        for byte, r in arcs:
            keys.append(q << 8 | byte)
            to.append(r)
            skip.append(before)
            before += counts[r]
    ids = [entries[w] for w in words]
    arrays = [
        np.array([root, len(nodes)], np.int64), np.array(keys, np.int64), np.array(to, np.int32), np.array(skip, np.int32),
        np.array([f for f, _ in nodes], np.uint8), np.cumsum([0, *map(len, ids)]).astype(np.int32),
        np.array([i for x in ids for i in x], np.int32),
    ]
    head = np.array([a.nbytes for a in arrays], np.int64).tobytes()
    return MAGIC + head + b"".join(a.tobytes() for a in arrays)


class Lexicon:
    """A compiled lexicon in a memory-mapped file, which all workers of a machine share."""

    TYPES = (np.int64, np.int64, np.int32, np.int32, np.uint8, np.int32, np.int32)

    def __init__(self, blob: bytes):
        path = os.path.join(tempfile.gettempdir(), f"lexicon-{hashlib.sha256(blob).hexdigest()[:24]}.madt")
        if not os.path.exists(path):
            fd, part = tempfile.mkstemp(dir=tempfile.gettempdir())
            with os.fdopen(fd, "wb") as f:
                f.write(blob)
            os.replace(part, path)
        raw = np.memmap(path, np.uint8, "r")
        sizes = raw[8 : 8 + 8 * len(self.TYPES)].view(np.int64)
        at, arrays = 8 + 8 * len(self.TYPES), []
        for size, kind in zip(sizes.tolist(), self.TYPES):
            arrays.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
            at += size
        head, self.keys, self.to, self.skip, self.final, self.offsets, self.ids = arrays
        self.root = int(head[0])

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """Each word's rank among the lexicon's words, or -1; all words take their steps together."""
        n = len(words)
        out = np.full(n, -1, np.int64)
        if not n or not len(self.keys):
            return out
        lengths = np.array([len(w) for w in words])
        data, starts = np.frombuffer(b"".join(words), np.uint8).astype(np.int64), np.cumsum(lengths) - lengths
        alive, state, rank, step = np.flatnonzero(lengths), np.full(n, self.root, np.int64), np.zeros(n, np.int64), 0
        while len(alive):
            key = state[alive] << 8 | data[starts[alive] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            alive, at = alive[ok], at[ok]
            state[alive] = self.to[at]
            rank[alive] += self.skip[at]
            step += 1
            ended = lengths[alive] == step
            done = alive[ended]
            done = done[self.final[state[done]] == 1]
            out[done] = rank[done]
            alive = alive[~ended]
        return out

    def ids_of(self, rank: int) -> bytes:
        return self.ids[self.offsets[rank] : self.offsets[rank + 1]].astype("<u4").tobytes()


# ---------------------------------------------------------------- codec


def _byte_letters() -> list[str]:
    """The public byte-level alphabet: printable bytes stand for themselves, others for letters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, more = {b: chr(b) for b in own}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(more)
            more += 1
    return [letters[b] for b in range(256)]


class Codec:
    """Encodes and decodes chunks (runs without white space), which never share a token with one another."""

    def __init__(self, spec: dict, lexicon: Lexicon | None = None, memo: int = 300_000):
        model = spec["model"]
        self.vocab, self.lexicon, self.most = model["vocab"], lexicon, memo
        self.suffix = model["end_of_word_suffix"] or ""
        self.letters = _byte_letters()
        pairs = [m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"]]
        self.merges = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        keys = np.array([a << 20 | b for a, b in self.merges], np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ranks, self.pair_ids = np.array(list(self.merges.values()), np.int64)[order].T.copy()
        self.first = [self.vocab[c] for c in self.letters]
        self.final = [self.vocab[c + self.suffix] for c in self.letters]
        self.first_ids, self.final_ids = np.array(self.first), np.array(self.final)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text = {i: t.encode() for t, i in (self.vocab | self.special).items()}
        cut = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")
        self.cut = regex.compile(cut)
        self.apart = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.memo: dict[str, tuple[bytes, bytes]] = {}

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece (little-endian, 32 bits) by exact merges, lowest rank first and leftmost among equals.

        All pieces take a step together: each merges the best of its pairs, until none has any.
        """
        out: list[bytes] = [b""] * len(pieces)
        short = []
        for k, p in enumerate(pieces):
            if len(p) > LONG:
                out[k] = np.array(self._merge_long([self.first[b] for b in p[:-1]] + [self.final[p[-1]]]), "<u4").tobytes()
            elif p:
                short.append(k)
        if not short:
            return out
        who, size = np.array(short), np.array([len(pieces[k]) for k in short])
        ids = self.first_ids[np.frombuffer(b"".join([pieces[k] for k in short]), np.uint8)]
        end = np.cumsum(size)
        ids[end - 1] = self.final_ids[np.frombuffer(bytes([pieces[k][-1] for k in short]), np.uint8)]
        # the rank of the pair that begins at each symbol, and at a piece's last one none
        rank, new = self._ranks(ids, np.append(ids[1:], 0))
        rank[end - 1] = NONE
        while len(who):
            start = end - size
            best = np.minimum.reduceat(rank << 32 | np.arange(len(rank)), start)
            going = best >> 32 < NONE
            if not going.all():
                for k in np.flatnonzero(~going).tolist():
                    out[who[k]] = ids[start[k] : end[k]].astype("<u4").tobytes()
                stay = np.repeat(going, size)
                ids, rank, new = ids[stay], rank[stay], new[stay]
                who, size, best = who[going], size[going], best[going]
                if not len(who):
                    break
                at = (best & 0xFFFFFFFF) - (np.cumsum(~stay)[best & 0xFFFFFFFF])
            else:
                at = best & 0xFFFFFFFF
            ids[at] = new[at]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            last = at + 2 == np.cumsum(size)
            ids, rank, new = ids[keep], rank[keep], new[keep]
            size = size - 1
            end = np.cumsum(size)
            at = at - np.arange(len(at))  # one symbol has gone in each piece before
            rank[at], new[at] = self._ranks(ids[at], ids[np.minimum(at + 1, len(ids) - 1)])
            rank[at[last]] = NONE
            left = at[at > end - size] - 1
            rank[left], new[left] = self._ranks(ids[left], ids[left + 1])
        return out

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        ok = self.pair_keys[at] == key
        return np.where(ok, self.pair_ranks[at], NONE), self.pair_ids[at]

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list, for pieces of any length."""
        n = len(ids)
        left, right, heap = list(range(-1, n - 1)), [*range(1, n), -1], []
        for k in range(n - 1):
            if m := self.merges.get((ids[k], ids[k + 1])):
                heap.append((m[0], k, ids[k], ids[k + 1], m[1]))
        heapq.heapify(heap)
        while heap:
            _, k, a, b, new = heapq.heappop(heap)
            r = right[k]
            if ids[k] != a or r < 0 or ids[r] != b:
                continue
            ids[k], ids[r], right[k] = new, -1, right[r]
            if right[r] >= 0:
                left[right[r]] = k
            for x, y in ((left[k], k), (k, right[k])):
                if x >= 0 and y >= 0 and (m := self.merges.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (m[0], x, ids[x], ids[y], m[1]))
        return [i for i in ids if i >= 0]

    def pieces(self, chunk: str) -> list[bytes | int]:
        """What a chunk is cut into: pieces in UTF-8, and ids of special tokens."""
        out: list[bytes | int] = []
        for part in self.apart.split(chunk) if self.apart and "<|" in chunk else (chunk,):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                # letters are lower-cased one at a time, so a sigma at a word's end is like any other
                plain = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                out += [m.encode() for m in self.cut.findall(plain)]
        return out

    def learn(self, chunks: list[str]) -> None:
        """Puts chunks into the memo: the lexicon's words at once, others merged."""
        if len(self.memo) + len(chunks) > self.most:
            self.memo.clear()
        cut = [self.pieces(c) for c in chunks]
        new = list(dict.fromkeys(p for ps in cut for p in ps if isinstance(p, bytes)))
        ranks = self.lexicon.ranks(new).tolist() if self.lexicon else [-1] * len(new)
        unseen = [p for p, r in zip(new, ranks) if r < 0]
        ids_of: dict[bytes | int, bytes] = dict(zip(unseen, self.merge(unseen)))
        ids_of |= {p: self.lexicon.ids_of(r) for p, r in zip(new, ranks) if r >= 0}
        ids_of |= {i: np.array([i], "<u4").tobytes() for i in self.special.values()}
        for chunk, ps in zip(chunks, cut):
            ids = ids_of[ps[0]] if len(ps) == 1 else b"".join([ids_of[p] for p in ps])
            self.memo[chunk] = ids, self.decode(ids)

    def split(self, text: str) -> list[str]:
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to str.split() alone
            return [c for c in regex.split(r"\p{White_Space}+", text) if c]
        return text.split()

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """Per text, ids as little-endian unsigned 32-bit integers and the decoded text."""
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size < 1 << 20):
                size += len(texts[hi])
                hi += 1
            split = [self.split(t) for t in texts[lo:hi]]
            wanted = set().union(*split)
            new = wanted.difference(self.memo)
            if len(self.memo) + len(new) > self.most:
                self.memo.clear()
                new = wanted
            self.learn(sorted(new))
            for chunks in split:
                found = [self.memo[c] for c in chunks]
                yield b"".join([f[0] for f in found]), b" ".join([f[1] for f in found])
            lo = hi

    def decode(self, ids: bytes) -> bytes:
        return b" ".join([self.text[i] for i in memoryview(ids).cast("I")])


# ---------------------------------------------------------------- operator


def frequent_words(docs: DataFrame, most: int = 49_152, per_task: int = 65_536) -> list[str]:
    """The most frequent chunks of the corpus. Each task sends its most frequent ones.

    All texts are counted. The bounds decide which words are looked up instead of merged, and no result.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    seen.update(t.lower().split())
            if len(seen) > 8 * per_task:
                seen = Counter(dict(seen.most_common(4 * per_task)))
        top = [(w, n) for w, n in seen.most_common(per_task) if n > 1]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["word", "n"])

    counts = docs.select("text").mapInArrow(lean(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = stage(counts, "words")
    total = counts.agg(F.sum("n")).collect()[0][0] or 0
    # no more than 16 times the words asked for can be this frequent, which bounds what is sent to the driver
    often = counts.where(F.col("n") * (16 * most) >= total)
    words = [r.word for r in often.orderBy(F.desc("n"), "word").limit(most).select("word").collect()]
    discard(counts)
    return words


def build_lexicon(spec: dict, words: list[str]) -> bytes:
    codec = Codec(spec)
    pieces = list(dict.fromkeys(p for w in words for p in codec.pieces(w) if isinstance(p, bytes) and len(p) <= 64))
    return compile_lexicon({p: np.frombuffer(ids, "<u4").tolist() for p, ids in zip(pieces, codec.merge(pieces))})


SCHEMA = "n_tokens long, ids binary, decoded string"


def encode(docs: DataFrame, vocabulary: str | None = None, digest: bool = False) -> DataFrame:
    """The documents' columns but text, then n_tokens with ids and decoded text, or their SHA-256 if digest.

    vocabulary: a file of the public tokenizers that every machine has, or any file that the driver can open.
    Null texts count as empty: no ids, an empty decoded text. Ties and repeated rows get equal results; an empty table
    gives an empty one; columns of docs that bear the name of a result are replaced.
    """
    with open(vocabulary or public_vocabulary()) as f:
        spec = json.load(f)
    sc = docs.sparkSession.sparkContext
    spec_sent, lexicon_sent = sc.broadcast(json.dumps(spec)), sc.broadcast(build_lexicon(spec, frequent_words(docs)))
    names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["n_tokens", "ids", "decoded"]
    keep = [c for c in docs.columns if c != "text" and c not in names]
    shape = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else SCHEMA
    what = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[f"`{c}`" for c in keep]).schema), shape])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(json.loads(spec_sent.value), Lexicon(lexicon_sent.value))
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                n, ids, texts = [], [], []
                for raw, decoded in codec.encode([t or "" for t in part.column(part.num_columns - 1).to_pylist()]):
                    n.append(len(raw) // 4)
                    ids.append(hashlib.sha256(raw).hexdigest() if digest else raw)
                    texts.append(hashlib.sha256(decoded).hexdigest() if digest else decoded.decode())
                kind = pa.string() if digest else pa.binary()
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(n, pa.int64()), pa.array(ids, kind), pa.array(texts, pa.string())], names=[*keep, *names])

    return docs.select(*[f"`{c}`" for c in keep], F.col("text").alias("__text")).mapInArrow(lean(run), what)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir).select("doc_id", "text"), digest=True)
