"""Secret scans: base patterns, and probabilistic automata inferred from labelled credentials.

Grammar inference merges statistically compatible states of the prefix tree of labelled credentials
(Hoeffding bounds, red-blue order). What stays is a probabilistic automaton over classes of characters. Every candidate
token is scored by its likelihood under the automata against that of an automaton of ordinary tokens.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, lean, stage
from .textblock import Block

KINDS = ("assign", "access", "hex", "format")
#: Fixed patterns; `least` characters in the group named, which is judged after matching.
PATTERNS = (
    (re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 1, 6),
    (re.compile(rb"AKIA[A-Z0-9]+"), 0, 20),
    (re.compile(rb"[0-9a-f]{24,}"), 0, 24),
)
#: Candidates are runs of these characters, without dots at their ends, of so many characters; longer ones than LONG are walked one by one.
_WITHIN_TOKEN = np.zeros(256, bool)
_WITHIN_TOKEN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")] = True
SHORTEST, LONG = 6, 64
#: Bits by which a secret's likelihood exceeds an ordinary token's: over the whole token, and a character. The first is the odds against a token being a secret.
ODDS, MARGIN = 40.0, 0.25
CHUNK = 1 << 20


# ---------------------------------------------------------------- automata


#: Classes of characters: digits, hexadecimal letters, other letters, and the rest, with their sizes.
_CLASSES = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+/=", "_-.")
_CLASS_OF = {ord(c): k for k, cs in enumerate(_CLASSES) for c in cs}
_OTHER, _END = len(_CLASSES), len(_CLASSES) + 1
_WITHIN = [math.log2(len(c)) for c in _CLASSES] + [math.log2(256 - sum(map(len, _CLASSES)))]


_CLASS = np.array([_CLASS_OF.get(b, _OTHER) for b in range(256)])


def symbols(token: bytes) -> list[int]:
    return _CLASS[np.frombuffer(token, np.uint8)].tolist()


class Automaton:
    """A deterministic probabilistic automaton learned from tokens; loglik() is in bits a character."""

    def __init__(self, tokens: list[bytes], alpha: float = 0.05):
        self.next: list[dict[int, int]] = [{}]
        self.count: list[dict[int, int]] = [{}]
        for token in tokens:
            at = 0
            for s in symbols(token):
                self.count[at][s] = self.count[at].get(s, 0) + 1
                if s not in self.next[at]:
                    self.next[at][s] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                at = self.next[at][s]
            self.count[at][_END] = self.count[at].get(_END, 0) + 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._infer()
        self._compile()

    def _total(self, q: int) -> int:
        return sum(self.count[q].values())

    def _alike(self, p: int, q: int) -> bool:
        """Whether p and q, and what follows them, differ by no more than Hoeffding bounds."""
        pairs = [(p, q)]
        while pairs:
            p, q = pairs.pop()
            n, m = self._total(p), self._total(q)
            if not n or not m:
                continue
            gap = self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            for s in self.count[p].keys() | self.count[q].keys():
                if abs(self.count[p].get(s, 0) / n - self.count[q].get(s, 0) / m) > gap:
                    return False
                if s in self.next[p] and s in self.next[q] and self.next[p][s] != self.next[q][s]:
                    pairs.append((self.next[p][s], self.next[q][s]))
        return True

    def _fold(self, p: int, q: int) -> None:
        """Adds the tree below q to the states that p leads to."""
        pairs = [(p, q)]
        while pairs:
            p, q = pairs.pop()
            for s, n in self.count[q].items():
                self.count[p][s] = self.count[p].get(s, 0) + n
            for s, r in self.next[q].items():
                if s in self.next[p]:
                    pairs.append((self.next[p][s], r))
                else:
                    self.next[p][s] = r

    def _infer(self) -> None:
        """Blue states (children of red ones) merge with the first red state that is alike, or turn red."""
        red = [0]
        while True:
            blue = [(p, s, q) for p in red for s, q in sorted(self.next[p].items()) if q not in red]
            if not blue:
                break
            p, s, q = max(blue, key=lambda x: (self._total(x[2]), -x[2]))
            for r in red:
                if self._alike(r, q):
                    self.next[p][s] = r
                    self._fold(r, q)
                    break
            else:
                red.append(q)
        self.red = red

    def _compile(self) -> None:
        """Smoothed bits of each arc; a class unseen in a state is unlikely and stays in the state."""
        number = {q: k for k, q in enumerate(self.red)}
        self.arc = []
        for q in self.red:
            n, arcs = self._total(q), []
            for s in range(_END + 1):
                bits = math.log2((self.count[q].get(s, 0) + 0.05) / (n + 0.05 * (_END + 1))) if n else -8.0
                arcs.append((bits - (_WITHIN[s] if s < _END else 0), number.get(self.next[q].get(s, q), number[q])))
            self.arc.append(arcs)
        self.bits = np.array([[b for b, _ in arcs] for arcs in self.arc])
        self.to = np.array([[q for _, q in arcs] for arcs in self.arc])

    def loglik(self, token: bytes) -> float:
        at, bits = 0, 0.0
        for s in symbols(token):
            b, at = self.arc[at][s]
            bits += b
        return (bits + self.arc[at][_END][0]) / max(1, len(token))

    def logliks(self, classes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """loglik() of the tokens that begin at starts in an array of classes, all together, longest first; none longer than LONG."""
        at, bits = np.zeros(len(starts), np.int64), np.zeros(len(starts))
        for k in range(int(lengths[0]) if len(lengths) else 0):
            n = int(np.searchsorted(-lengths, -k, "left"))  # those that have a character here
            s = classes[starts[:n] + k]
            bits[:n] += self.bits[at[:n], s]
            at[:n] = self.to[at[:n], s]
        return (bits + self.bits[at, _END]) / np.maximum(lengths, 1)


class Formats:
    """Automata by kind and one of ordinary tokens. A token is a secret if a kind's automaton finds it likelier than that of ordinary
    tokens by ODDS bits, and by half as many bits a character as all but a hundredth of the kind's own tokens, MARGIN at least.

    Ordinary tokens come unlabelled: those found to be secrets are taken out, and the rest is learned again.
    """

    def __init__(self, labelled: dict[str, list[bytes]], ordinary: list[bytes]):
        self.automata = {k: Automaton(v) for k, v in sorted(labelled.items()) if len(v) >= 5}
        for again in (True, False):
            self.ordinary = Automaton(ordinary) if ordinary else None
            own = {k: sorted(self._margin(a, t) for t in labelled[k]) for k, a in self.automata.items()}
            self.least = {k: max(MARGIN, m[len(m) // 100] / 2) for k, m in own.items()}
            if again:
                ordinary = [t for t in ordinary if not self.is_secret(t)]

    def _margin(self, a: Automaton, token: bytes) -> float:
        return a.loglik(token) - (self.ordinary.loglik(token) if self.ordinary else -math.log2(64))

    def is_secret(self, token: bytes) -> bool:
        return any((m := self._margin(a, token)) >= self.least[k] and m * len(token) >= ODDS for k, a in self.automata.items())

    def are_secrets(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """is_secret() of many tokens in an array of bytes."""
        out = np.zeros(len(starts), bool)
        if not self.automata:
            return out
        for k in np.flatnonzero(lengths > LONG).tolist():
            out[k] = self.is_secret(data[starts[k] : starts[k] + lengths[k]].tobytes())
        some = np.flatnonzero(lengths <= LONG)
        some = some[np.argsort(-lengths[some], kind="stable")]
        classes, a, n = _CLASS[data], starts[some], lengths[some]
        plain = self.ordinary.logliks(classes, a, n) if self.ordinary else -math.log2(64)
        for kind, automaton in self.automata.items():
            margin = automaton.logliks(classes, a, n) - plain
            out[some[(margin >= self.least[kind]) & (margin * n >= ODDS)]] = True
        return out


# ---------------------------------------------------------------- scan


class Chunk:
    """Texts joined by line feeds, which no pattern crosses: base spans (start, kind, end), and candidates that no base span covers."""

    def __init__(self, texts: list[bytes]):
        self.joined = b"\n".join(texts)
        self.first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        spans = []
        for kind, (pattern, group, least) in enumerate(PATTERNS):
            spans += [(m.start(), kind, m.end()) for m in pattern.finditer(self.joined) if m.end(group) - m.start(group) >= least]
        self.spans = sorted(spans)
        self.data = np.frombuffer(self.joined, np.uint8)
        self.block = Block(self.data, np.array([0, len(self.data)]), 0, 1, between=~_WITHIN_TOKEN)
        starts, ends = self.block.starts, self.block.ends
        if len(starts):
            at, solid = np.arange(len(self.data)), self.data != ord(".")
            after = np.maximum.accumulate(np.where(solid, at, -1))
            before = np.minimum.accumulate(np.where(solid, at, len(at))[::-1])[::-1]
            starts, ends = before[starts], after[ends - 1] + 1
        long = ends - starts >= SHORTEST
        starts, ends = starts[long], ends[long]
        cover = _merged([(s, e) for s, _, e in self.spans])
        if cover:
            low, high = np.array(cover).T
            k = np.searchsorted(low, starts, "right") - 1
            free = (k < 0) | (ends > high[np.maximum(k, 0)])
            starts, ends = starts[free], ends[free]
        self.starts, self.lengths = starts, ends - starts
        self.hash = self.block.hashes(self.starts, self.lengths)

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, "right") - 1

    def found(self, formats: Formats) -> list[tuple[int, int, int]]:
        """Base spans and the candidates that are secrets, sorted. Equal tokens are scored once."""
        _, one, every = np.unique(self.hash, return_index=True, return_inverse=True)
        hit = formats.are_secrets(self.data, self.starts[one], self.lengths[one])[every] if len(one) else np.zeros(0, bool)
        return sorted(self.spans + [(s, 3, s + n) for s, n in zip(self.starts[hit].tolist(), self.lengths[hit].tolist())])


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, Chunk]]:
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= CHUNK):
            size += len(texts[hi])
            hi += 1
        yield lo, Chunk(texts[lo:hi])
        lo = hi


def learn(docs: DataFrame, labelled: dict[str, list[bytes]] | None = None, per_kind: int = 1000, ordinary: int = 20_000) -> Formats:
    """Automata from up to per_kind distinct labelled credentials of each kind, those of smallest hash.

    Labels are given, or come from the base patterns, whose hits are credentials by form. `ordinary` distinct tokens,
    those of smallest hash among all candidates of all texts, are the background. The bounds limit what a classifier is
    fitted on; every candidate is scored. Each task passes on no more than the bounds.
    """

    bounds = [per_kind] * 3 + [ordinary]

    def put(held: list[dict[int, bytes]], kind: int, h: list[int], tokens: Iterator[bytes]) -> None:
        mine = held[kind]
        for x, t in zip(h, tokens):
            mine.setdefault(x, t)
        for x in sorted(mine)[bounds[kind] :]:
            del mine[x]

    def rows(held: list[dict[int, bytes]]) -> pa.RecordBatch:
        flat = [(k, x - (1 << 63), t) for k, mine in enumerate(held) for x, t in mine.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in flat], t) for n, t in enumerate((pa.int32(), pa.int64(), pa.binary()))], names=["kind", "h", "token"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[int, bytes]] = [{} for _ in KINDS]

        def least(kind: int, h: np.ndarray, starts: np.ndarray, lengths: np.ndarray, c: Chunk) -> None:
            h, at = np.unique(h, return_index=True)
            at = at[: bounds[kind]]
            put(held, kind, h[: bounds[kind]].tolist(), (c.joined[starts[k] : starts[k] + lengths[k]] for k in at.tolist()))

        for batch in batches:
            for _, c in _chunks(batch.column(0).fill_null(b"").to_pylist()):
                least(3, c.hash, c.starts, c.lengths, c)
                for kind, (pattern, group, _) in enumerate(PATTERNS):
                    at = [pattern.match(c.joined, s).span(group) for s, k, _ in c.spans if k == kind]
                    if at:
                        starts, ends = np.array(at).T
                        least(kind, c.block.hashes(starts, ends - starts), starts, ends - starts, c)
        yield rows(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[int, bytes]] = [{} for _ in KINDS]
        for batch in batches:
            kinds, hashes, tokens = (c.to_pylist() for c in batch.columns)
            for kind in set(kinds):
                put(held, kind, *zip(*((x + (1 << 63), t) for k, x, t in zip(kinds, hashes, tokens) if k == kind)))
        yield rows(held)

    # what tasks found is merged in a tree, so that no task and not the driver gets more than some tasks' bounds
    tokens = stage(docs.select(F.col("text").cast("binary")).mapInArrow(lean(run), "kind int, h long, token binary"), "tokens")
    n, most = tokens.count(), sum(bounds)
    while n > 4 * most:
        n //= 4
        tokens = tokens.repartition(-(-n // most)).mapInArrow(lean(merge), "kind int, h long, token binary")
    found = next(merge(iter(tokens.toArrow().to_batches())))
    taken: list[list[bytes]] = [[] for _ in KINDS]
    for kind, _, token in sorted(zip(*(c.to_pylist() for c in found.columns))):
        taken[kind].append(token)
    return Formats(labelled if labelled is not None else dict(zip(KINDS, taken[:3])), taken[3])


def find_secrets(docs: DataFrame, labelled: dict[str, list[bytes]] | None = None) -> DataFrame:
    """Rows (doc_id, n_assign, n_access, n_hex, base_sha256, spans), one for each row of docs.

    Null and empty texts have no spans. Offsets are code points. Other columns of docs are ignored; ties and
    repeated rows get equal results; an empty table gives an empty one; without credentials to learn from only base
    spans are returned. An added span may reach over base ones.
    """
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, labelled))

    def text_of(spans: list[tuple[int, int, int]]) -> str:
        return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans: list[list[tuple[int, int, int]]] = [[] for _ in range(batch.num_rows)]
            for lo, c in _chunks(batch.column(1).fill_null(b"").to_pylist()):
                found = c.found(sent.value)
                if found:
                    points = np.concatenate([[0], np.cumsum((c.data & 0xC0) != 0x80)])  # code points before each byte
                    s, kind, e = np.array(found).T
                    text = c.text_of(s)
                    base = points[c.first[text]]
                    for t, *x in zip(text.tolist(), (points[s] - base).tolist(), kind.tolist(), (points[e] - base).tolist()):
                        spans[lo + t].append(tuple(x))
            bases = [[x for x in row if x[1] < 3] for row in spans]
            cols = [pa.array([sum(k == kind for _, k, _ in row) for row in bases], pa.int64()) for kind in range(3)]
            cols += [pa.array([hashlib.sha256(text_of(row).encode()).hexdigest() for row in bases], pa.string()), pa.array([text_of(row) for row in spans], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(lean(run), f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def _merged(cuts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(cuts):
        if out and s < out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def redact(docs: DataFrame, mark: str = "[SECRET]", labelled: dict[str, list[bytes]] | None = None) -> DataFrame:
    """The documents with every secret replaced by a mark; n_chars, where there is one, follows the text.

    Texts without secrets, null and empty ones stay as they are. No document is dropped, repeated rows get equal texts,
    columns of any name pass, and an empty table gives an empty one.
    """
    formats = docs.sparkSession.sparkContext.broadcast(learn(docs, labelled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index("text")
            texts = batch.column(k).cast(pa.binary()).to_pylist()
            for lo, c in _chunks([t or b"" for t in texts]):
                cuts = _merged([(s, e) for s, _, e in c.found(formats.value)])
                owner = c.text_of(np.array([s for s, _ in cuts], np.int64)).tolist()
                for t, (s, e) in reversed(list(zip(owner, cuts))):
                    s, e = s - int(c.first[t]), e - int(c.first[t])
                    texts[lo + t] = texts[lo + t][:s] + mark.encode() + texts[lo + t][e:]
            yield batch.set_column(k, batch.schema.field(k), pa.array(texts, pa.binary()).cast(batch.schema.field(k).type))

    out = docs.mapInArrow(lean(run), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(documents(spark, sf_dir).select("doc_id", "text"))
