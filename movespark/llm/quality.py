"""Quality rules as a short-circuit cascade, ordered by rejection per cost as estimated on a sample."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .textblock import Block, blocks

_SYMBOL, _LETTER, _TAIL = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LETTER[[*range(65, 91), *range(97, 123), *range(192, 256)]] = True
_TAIL[128:192] = True
WINDOW = 8


class Measures:
    """Figures of a block's texts, each made when first asked for."""

    def __init__(self, block: Block):
        self.block, self.made = block, {}

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self.made:
            self.made[name] = getattr(self, name)()
        return self.made[name]

    def n_words(self) -> np.ndarray:
        return self.block.n_words

    def word_chars(self) -> np.ndarray:
        return self.block.sums(self.block.word & ~_TAIL[self.block.data])

    def n_symbols(self) -> np.ndarray:
        return self.block.sums(_SYMBOL[self.block.data])

    def _lines(self) -> np.ndarray:
        """Per text, lines with a word, and those equal to an earlier line."""
        raw, off = self.block.data.tobytes(), self.block.offsets
        out = np.zeros((2, len(off) - 1), np.int64)
        for k in range(len(off) - 1):
            lines = [x for x in raw[off[k] : off[k + 1]].split(b"\n") if x.strip()]
            out[:, k] = len(lines), len(lines) - len(set(lines))
        return out

    def n_lines(self) -> np.ndarray:
        return self["_lines"][0]

    def n_dup_lines(self) -> np.ndarray:
        return self["_lines"][1]

    def n_repeat_words(self) -> np.ndarray:
        b = self.block
        h, at = b.windows(b.word_hashes(), WINDOW)
        text = np.repeat(np.arange(len(b.n_words), dtype=np.uint64), b.n_words)[at]
        h = h + text * np.uint64(0x9E3779B97F4A7C15)
        order = np.sort(h)
        again = np.unique(order[1:][order[1:] == order[:-1]])
        marks = np.zeros(len(b.starts) + 1, np.int64)
        if len(again):
            hit = at[again[np.minimum(np.searchsorted(again, h), len(again) - 1)] == h]
            np.add.at(marks, hit, 1)
            np.add.at(marks, hit + WINDOW, -1)
        total = np.concatenate([[0], np.cumsum(np.cumsum(marks[:-1]) > 0)])
        return total[b.first[1:]] - total[b.first[:-1]]

    def n_letter_words(self) -> np.ndarray:
        b = self.block
        letters = np.concatenate([[0], np.cumsum(_LETTER[b.data])])
        has = np.concatenate([[0], np.cumsum(letters[b.ends] > letters[b.starts])])
        return has[b.first[1:]] - has[b.first[:-1]]


@dataclass(frozen=True)
class Rule:
    """Rejects the texts for which fails() is true. cost and rejects: seconds and share of texts of a sample."""

    name: str
    fails: Callable[[Measures], np.ndarray] = field(repr=False)
    cost: float = 1.0
    rejects: float = 0.0


#: The base rule comes as two; the rest are bounds that ordinary prose keeps well inside.
RULES = (
    Rule("few_words", lambda m: m["n_words"] < 20),
    Rule("repeated_words", lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"]),
    Rule("symbols", lambda m: 100 * m["n_symbols"] > 25 * m["n_words"]),
    Rule("word_length", lambda m: (2 * m["word_chars"] < 5 * m["n_words"]) | (m["word_chars"] > 15 * m["n_words"])),
    Rule("few_letters", lambda m: 100 * m["n_letter_words"] < 70 * m["n_words"]),
    Rule("repeated_lines", lambda m: 100 * m["n_dup_lines"] > 50 * m["n_lines"]),
)


def _take(block: Block, keep: np.ndarray) -> Block:
    """A block of some of a block's texts, of which later rules need no more than that."""
    parts = [block.data[block.offsets[k] : block.offsets[k + 1]] for k in keep]
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return Block(np.concatenate(parts) if parts else np.empty(0, np.uint8), offsets, 0, len(keep))


class Part:
    """Measures of the texts that are left: read where they are known for all, made for those alone where few are left."""

    def __init__(self, whole: Measures, alive: np.ndarray, own: dict[str, np.ndarray] | None = None):
        self.whole, self.alive, self.own, self.few = whole, alive, own or {}, None

    def __getitem__(self, name: str) -> np.ndarray:
        if name in self.own:
            return self.own[name]
        if name in self.whole.made or 2 * len(self.alive) > len(self.whole.block.n_words):
            return self.whole[name][..., self.alive]
        if self.few is None:
            self.few = Measures(_take(self.whole.block, self.alive))
        self.own[name] = self.few[name]
        return self.own[name]

    def left(self, keep: np.ndarray) -> Part:
        return Part(self.whole, self.alive[keep], {n: v[..., keep] for n, v in self.own.items()})


def run_rules(measures: Measures, rules: tuple[Rule, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Per text, the position of the first rule that rejects it, or -1, and how many rules judged it.

    A rejected text goes to no later rule. What is measured already is not measured again.
    """
    n = len(measures.block.n_words)
    verdict, tried, part = np.full(n, -1), np.zeros(n, np.int64), Part(measures, np.arange(n))
    for k, rule in enumerate(rules):
        if not len(part.alive):
            break
        tried[part.alive] += 1
        bad = rule.fails(part)
        if bad.any():
            verdict[part.alive[bad]] = k
            part = part.left(~bad)
    return verdict, tried


def plan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = 1000) -> tuple[Rule, ...]:
    """The rules in the order of rejection per second, each timed alone on about `sample` texts drawn from the whole table.

    Rules are timed where the texts are; only sums come to the driver. The verdict of a cascade doesn't depend on the
    order; only its cost does. An empty table keeps the order given.
    """
    share = min(1.0, sample / max(1, docs.count()))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((2, len(rules))), 0
        for batch in batches:
            n += batch.num_rows
            for b in blocks(batch.column(0)):
                for k, rule in enumerate(rules):
                    began = time.thread_time()
                    total[1, k] += int(np.count_nonzero(rule.fails(Measures(b))))
                    total[0, k] += time.thread_time() - began
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(rules))), pa.array(total[0]), pa.array(total[1]), pa.array([n] * len(rules))], names=["k", "cost", "bad", "n"])

    rows = docs.select(F.col("text").cast("binary")).where(F.rand(11) < share).mapInArrow(measure, "k long, cost double, bad double, n long")
    found = {r.k: r for r in rows.groupBy("k").agg(F.sum("cost").alias("cost"), F.sum("bad").alias("bad"), F.sum("n").alias("n")).collect()}
    if not found:
        return rules
    measured = [Rule(r.name, r.fails, max(found[k].cost, 1e-6), found[k].bad / found[k].n) for k, r in enumerate(rules)]
    return tuple(sorted(measured, key=lambda r: -r.rejects / r.cost))


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string, rules_tried long"


def judge(docs: DataFrame, rules: tuple[Rule, ...] | None = None, figures: bool = True) -> DataFrame:
    """The documents' columns but text, then the figures and the verdict of the cascade.

    Null and empty texts have no words and fail the first base rule. A document is judged by its whole text
    alone, so ties and repeated rows get equal verdicts; an empty table gives an empty table. Columns of docs
    that bear the name of a figure are replaced. Figures are made once, and rules read them; what only later rules need is
    made for the texts that are left. figures=False leaves figures null: then a text that a rule rejects costs no more.
    rules_tried tells how many rules judged a text.
    """
    rules = plan(docs) if rules is None else rules
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    keep = [c for c in docs.columns if c != "text" and c not in names]
    what = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[f"`{c}`" for c in keep]).schema), SCHEMA])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = np.array([r.name for r in rules] + [None], object)
        for batch in batches:
            for b in blocks(batch.column(batch.num_columns - 1)):
                m = Measures(b)
                if figures:
                    cols = [m[n].astype(np.int64) for n in names[:5]]
                    base = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
                verdict, tried = run_rules(m, rules)
                if not figures:
                    cols = [b.n_words.astype(np.int64)] + [pa.nulls(len(verdict), pa.int64())] * 4
                    base = np.isin(labels[verdict], ["few_words", "repeated_words"])
                out = [pa.array(c) if isinstance(c, np.ndarray) else c for c in cols]
                out += [pa.array(base), pa.array(verdict < 0), pa.array(labels[verdict].tolist(), pa.string()), pa.array(tried)]
                part = batch.slice(b.lo, b.hi - b.lo)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *out], names=[*keep, *names])

    return docs.select(*[f"`{c}`" for c in keep], F.col("text").cast("binary").alias("text")).mapInArrow(run, what)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that no rule rejects, with their columns, whatever their names.

    Null and empty texts go; repeated rows stay or go together; an empty table gives an empty one.
    """
    rules = plan(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [run_rules(Measures(b), rules)[0] < 0 for b in blocks(batch.column(batch.schema.get_field_index("text")))]
            if good:
                yield batch.filter(pa.array(np.concatenate(good)))

    return docs.mapInArrow(run, docs.schema)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    # which rule is first depends on the order that timing finds
    return judge(documents(spark, sf_dir).select("doc_id", "text")).drop("rejected_by", "rules_tried")
