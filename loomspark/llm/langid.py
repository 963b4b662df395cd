"""Language ID: a linear-chain conditional random field over the words of a text.

Features of a word are hashed: letter 2- and 3-grams of the word between marks for its ends (so affixes of one and two
letters are among them), affixes of three letters, single letters beyond ASCII, and its entry in a lexicon of words that
one language favours. All features of a word count, however long it is: a run of letters without spaces is one word. With
learned transitions between labels, forward-backward over the whole text gives every word the probability of each label,
so code-switched texts are labelled word by word; a document's score for a language is the mean over its words. Long texts
are worked on in pieces that pass on exactly what forward-backward needs of the rest, so pieces change no result.

The model is fitted on the driver from a bounded sample: of eligible rows (lang not null, and not held out), those of
each language with the lowest hash of (doc_id, text), `per_label` at most, with their whole texts. Half of what they hold is
trained on as it stands, half in runs of several languages put together, so that transitions are seen.
lang, source and doc_id are never inputs of a prediction.

A null text and one without a letter get `und` and score 0. Ties go to the first label in order. Without any labelled
row everything is `und`. Equal texts get equal results; texts are read whole, a few MB at a time; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.llm.common import free_names, mapped, slices

UND = "und"
PIECE = 256  # words of a text that are worked on at a time
BUCKETS = 1 << 16
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters (and of what Python counts with them, sorted out later), lower case."""
    return _WORD.findall(text.lower())


def _bucket(kind: int, *codes: np.ndarray) -> np.ndarray:
    h = np.full(len(codes[0]), 0x9E3779B1 * (kind + 1) & 0xFFFFFFFF, np.uint32)
    for c in codes:
        h = (h ^ c) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
    return (h * np.uint32(0xC2B2AE35) >> np.uint32(8)) & np.uint32(BUCKETS - 1)


def feature_rows(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The feature numbers of all words in a row, and how many each word has (three at least)."""
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes = np.frombuffer(f"^{'$^'.join(words)}$".encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    start = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(start + sizes, sizes) - np.arange(len(codes))  # characters of the word from here on
    at = lambda i: codes[i : len(codes) - 3 + i]
    codes = np.concatenate([codes, np.zeros(3, np.uint32)])
    long = np.flatnonzero(sizes >= 5)
    heads, tails = start[long], (start + sizes)[long] - 4
    parts = [(np.flatnonzero(left >= 2), 0, 2), (np.flatnonzero(left >= 3), 1, 3), (heads, 2, 4), (tails, 3, 4)]
    flat = [_bucket(kind, *(at(i)[where] for i in range(n))) for where, kind, n in parts]
    own = [owner[where] for where, _, _ in parts]
    odd = np.flatnonzero(codes[:-3] > 0x7F)
    flat.append(_bucket(4, codes[odd]))
    own.append(owner[odd])
    known = [(i, label) for i, label in enumerate(map(lexicon.get, words)) if label is not None]
    if known:
        index, label = np.array(known).T
        flat.append(_bucket(5, label.astype(np.uint32)))
        own.append(index)
    flat, own = np.concatenate(flat), np.concatenate(own)
    return flat[np.argsort(own, kind="stable")].astype(np.int64), np.bincount(own, minlength=len(words))


def summed(weights: np.ndarray, flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The summed weights of each word's features."""
    if not len(counts):
        return np.zeros((0, weights.shape[1]), weights.dtype)
    return np.add.reduceat(weights[flat], np.cumsum(counts) - counts)


class Steps:
    """Words of chains laid out step by step, the first words of all chains, then the second ones, and so on, with the
    longest chains first: what a step works on is one slice, and no cell is empty."""

    def __init__(self, lens: np.ndarray):
        self.order = np.argsort(-lens, kind="stable")
        ordered = -lens[self.order]
        self.alive = np.searchsorted(ordered, -np.arange(int(-ordered[0]) if len(lens) else 0), "left").tolist()
        self.offset = np.concatenate(([0], np.cumsum(self.alive))).astype(np.int64)
        rank = np.empty(len(lens), np.int64)
        rank[self.order] = np.arange(len(lens))
        step = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
        self.place = self.offset[step] + np.repeat(rank, lens)

    def laid(self, words: np.ndarray) -> np.ndarray:
        out = np.empty_like(words)
        out[self.place] = words
        return out

    def of(self, rows: np.ndarray, t: int) -> np.ndarray:
        return rows[self.offset[t] : self.offset[t + 1]]


def forward_backward(psi: np.ndarray, lens: np.ndarray, trans: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of all words, expected transitions, log likelihood normalisers of chains.

    psi: potentials of the words of all chains in a row, lens: words of each chain, trans: potentials of label pairs.
    first, last: what comes into a chain's first word from before it, and into its last one from after it (ones)."""
    lay, k = Steps(lens), psi.shape[1]
    psi = lay.laid(psi)
    alpha, beta, norm = np.empty_like(psi), np.empty_like(psi), np.empty((len(psi), 1), psi.dtype)
    top, expected = len(lay.alive), np.zeros((k, k))
    for t in range(top):
        n = lay.alive[t]
        into = lay.of(alpha, t - 1)[:n] @ trans if t else (first[lay.order][:n] if first is not None else 1)
        a = lay.of(psi, t) * into
        z = a.sum(1, keepdims=True)
        lay.of(norm, t)[:] = z
        np.divide(a, z, out=lay.of(alpha, t))
    ends = None if last is None else last[lay.order]
    for t in range(top - 1, -1, -1):
        more = lay.alive[t + 1] if t + 1 < top else 0
        own = lay.of(beta, t)
        own[more:] = 1 if ends is None else ends[more : lay.alive[t]]
        if more:
            b = lay.of(psi, t + 1) * lay.of(beta, t + 1) / lay.of(norm, t + 1)
            own[:more] = b @ trans.T
            expected += trans * (lay.of(alpha, t)[:more].T @ b)
    gamma = alpha * beta
    gamma /= gamma.sum(1, keepdims=True)
    return gamma[lay.place], expected, np.add.reduceat(np.log(norm[lay.place, 0]), np.cumsum(lens) - lens) if len(lens) else np.empty(0)


def _passages(psi: np.ndarray, lens: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """(chains, labels, labels): for each label that comes in alone before a chain's first word, what its forward pass
    ends with, up to a factor of the chain."""
    lay = Steps(lens)
    psi = lay.laid(psi.astype(np.float64))
    state = np.empty((len(lens), psi.shape[1], psi.shape[1]))
    for t, n in enumerate(lay.alive):
        p = lay.of(psi, t)[:, None, :]
        state[:n] = np.eye(psi.shape[1]) * p if t == 0 else (state[:n] @ trans) * p
        state[:n] /= state[:n].sum((1, 2), keepdims=True)
    out = np.empty_like(state)
    out[lay.order] = state
    return out


def whole_marginals(psi: np.ndarray, lens: np.ndarray, trans: np.ndarray, piece: int = PIECE) -> np.ndarray:
    """The marginals of forward_backward() over whole texts of any length, in steps of one piece."""
    parts = -(-lens // piece)
    base = np.cumsum(parts) - parts
    sizes = np.full(int(parts.sum()), piece, np.int64)
    filled = lens > 0
    sizes[(base + parts - 1)[filled]] = (lens - (parts - 1) * piece)[filled]
    if not len(sizes):
        return np.empty((0, psi.shape[1]), psi.dtype)
    first, last, long = np.ones((len(sizes), psi.shape[1])), np.ones((len(sizes), psi.shape[1])), np.flatnonzero(parts > 1)
    if len(long):
        within = np.repeat(parts > 1, parts)
        through = np.empty((len(sizes), psi.shape[1], psi.shape[1]))
        through[within] = _passages(psi[np.repeat(within, sizes)], sizes[within], trans)
        unit = lambda x: x / x.sum(1, keepdims=True)
        for r in range(1, int(parts.max())):
            i = base[long[parts[long] > r]] + r
            first[i] = unit(np.einsum("nk,nkl->nl", first[i - 1], through[i - 1]) @ trans)
        for r in range(int(parts.max()) - 2, -1, -1):
            i = base[long[parts[long] > r + 1]] + r
            last[i] = unit(np.einsum("nlk,nk->nl", through[i + 1], last[i + 1]) @ trans.T)
    return forward_backward(psi, sizes, trans, first.astype(psi.dtype), last.astype(psi.dtype))[0]


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # (BUCKETS, labels)
    trans: np.ndarray  # log potentials
    lexicon: dict[str, int]

    def emissions(self, words: list[str]) -> np.ndarray:
        return summed(self.weights, *feature_rows(words, self.lexicon))


def learned_lexicon(texts: list[tuple[str, list[str]]], labels: list[str]) -> dict[str, int]:
    """word -> label for words that one label has far more often than the others."""
    counts = {x: Counter() for x in labels}
    for label, ws in texts:
        counts[label].update(ws)
    totals, out = {x: sum(c.values()) or 1 for x, c in counts.items()}, {}
    for i, x in enumerate(labels):
        for w, n in counts[x].items():
            others = max([counts[y][w] / totals[y] for y in labels if y != x], default=0)
            if n > 2 and n / totals[x] > 4 * others:
                out[w] = i
    return out


def training_chains(texts: list[tuple[int, np.ndarray]], rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
    """(word numbers, labels) of chains: texts in pieces; of every second piece short runs, put together at random. Every
    word of the texts is in one chain."""
    pieces = [(label, ws[i : i + PIECE]) for label, ws in texts for i in range(0, len(ws), PIECE)]
    chains, runs = [], []
    for i in rng.permutation(len(pieces)):
        label, ws = pieces[i]
        if rng.random() < 0.5:
            chains.append((ws, np.full(len(ws), label)))
            continue
        at = 0
        while at < len(ws):
            n = int(rng.integers(4, 24))
            runs.append((ws[at : at + n], label))
            at += n
    order, held = rng.permutation(len(runs)), []
    for j, i in enumerate(order):
        held.append(runs[i])
        if sum(len(ws) for ws, _ in held) >= PIECE // 2 or j == len(order) - 1:
            chains.append((np.concatenate([ws for ws, _ in held]), np.concatenate([np.full(len(ws), x) for ws, x in held])))
            held = []
    return chains


def fit(texts: list[tuple[str, list[str]]], labels: list[str], epochs: int = 40, seed: int = 7) -> Model:
    """A model from (label, words). Deterministic: same texts, same model."""
    rng, k = np.random.default_rng(seed), len(labels)
    lexicon, vocab = learned_lexicon(texts, labels), {}
    numbered = [(labels.index(label), np.array([vocab.setdefault(w, len(vocab)) for w in ws])) for label, ws in texts if ws]
    chains = training_chains(numbered, rng)
    flat, sizes = feature_rows(list(vocab), lexicon)
    w, t = np.zeros((BUCKETS, k)), np.zeros((k, k))
    gw, gt = np.full_like(w, 1e-6), np.full_like(t, 1e-6)
    if not chains:
        return Model(labels, w.astype(np.float32), t.astype(np.float32), lexicon)
    x, y = (np.concatenate([c[i] for c in chains]) for i in (0, 1))
    lens = np.array([len(c[0]) for c in chains])
    hot, seen, n = np.eye(k)[y], np.zeros((k, k)), len(chains)
    inner = np.ones(len(x), bool)
    inner[np.cumsum(lens) - 1] = False
    np.add.at(seen, (y[:-1][inner[:-1]], y[1:][inner[:-1]]), 1)
    for _ in range(epochs):
        e = summed(w, flat, sizes)
        psi = np.exp(e - e.max(1, keepdims=True))[x]
        gamma, expected, _ = forward_backward(psi, lens, np.exp(t))
        d = hot - gamma
        for j in range(k):
            by_word = np.bincount(x, d[:, j], minlength=len(sizes))
            g = np.bincount(flat, np.repeat(by_word, sizes), minlength=BUCKETS) / n - 1e-4 * w[:, j]
            gw[:, j] += g * g
            w[:, j] += 0.3 * g / np.sqrt(gw[:, j])
        g = (seen - expected) / n - 1e-3 * t
        gt += g * g
        t += 0.3 * g / np.sqrt(gt)
    return Model(labels, w.astype(np.float32), t.astype(np.float32), lexicon)


def held_out() -> Column:
    """Rows that nothing is learned from: crc32 of doc_id as text leaves 2 modulo 4. A null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def trained(docs: DataFrame, per_label: int = 160, most_labels: int = 100, most_bytes: int = 1 << 20) -> Model | None:
    """Fits a model on a bounded sample of docs' labelled rows: per_label whole texts of each language, each of most_bytes at
    most, of the most_labels languages with the most texts; None where there are none. Rows are picked by the hash of
    (doc_id, text), and equal ones count once, so neither one id on many rows nor rows without one change its size. A
    language whose texts are all longer is not learned."""
    able = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out() & (F.octet_length("text") <= most_bytes))
    able = able.select("lang", F.xxhash64("doc_id", "text").alias("h"), "text")
    sizes = able.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).orderBy(F.desc("n"), "lang").limit(most_labels).collect()
    if not sizes:
        return None
    # Hashes below this share of their range hold per_label texts and some more; the lowest of them count.
    share = F.lit(None).cast("double")
    for r in sizes:
        share = F.when(F.col("lang") == r.lang, F.lit(min(1.0, 1.6 * per_label / r.n))).otherwise(share)
    near = able.filter(F.col("h") <= (2 * share - 1) * float(2**63)).groupBy("lang", "h").agg(F.min("text").alias("text"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    sample = near.withColumn("nth", nth).filter(F.col("nth") <= per_label).select("lang", "h", "text").collect()
    labels = sorted(r.lang for r in sizes)
    texts = [(r.lang, [w for w in words_of(r.text) if any(map(str.isalpha, w))]) for r in sorted(sample)]
    return fit(texts, labels)


class Labeller(dict):
    """word -> row of a table of potentials, for words seen of late; -1 for words without a letter."""

    def __init__(self, model: Model, limit: int = 250_000):
        super().__init__()
        self.model, self.limit = model, limit
        self.trans = np.exp(model.trans)
        self.table = np.empty((limit, len(model.labels)), np.float32)
        self.filled, self.fresh = 0, []

    def __missing__(self, word: str) -> int:
        if not any(map(str.isalpha, word)):
            self[word] = -1
            return -1
        self[word] = at = self.filled + len(self.fresh)
        self.fresh.append(word)
        return at

    def settle(self) -> None:
        """Fills the table's rows of new words."""
        need = self.filled + len(self.fresh)
        if need > len(self.table):
            self.table = np.concatenate([self.table[: self.filled], np.empty((need * 2 - self.filled, self.table.shape[1]), np.float32)])
        for i in range(0, len(self.fresh), 4096):
            e = self.model.emissions(self.fresh[i : i + 4096])
            self.table[self.filled : self.filled + len(e)] = np.exp(e - e.max(1, keepdims=True))
            self.filled += len(e)
        self.fresh = []

    def reset(self) -> None:
        self.clear()
        self.filled, self.fresh, self.table = 0, [], self.table[: self.limit]

    def marginals(self, texts: list[str]) -> tuple[list[int], np.ndarray]:
        """How many words each text has, and the label probabilities of all words in a row."""
        if self.filled > self.limit // 2:
            self.reset()
        ids = []
        for t in texts:
            ws = words_of(t)
            a = np.fromiter(map(self.__getitem__, ws), np.int64, len(ws))
            ids.append(a[a >= 0])
        self.settle()
        counts = [len(a) for a in ids]
        if not sum(counts):
            return counts, np.empty((0, len(self.model.labels)), np.float32)
        return counts, whole_marginals(self.table[np.concatenate(ids)], np.array(counts), self.trans)

    def scores(self, texts: list[str]) -> list[tuple[str, float]]:
        return [(label, score) for label, score, _ in self.counted(texts)]

    def counted(self, texts: list[str]) -> list[tuple[str, float, int]]:
        """Label, score and words of each text."""
        counts, gamma = self.marginals(texts)
        out, at = [], 0
        for n in counts:
            if not n:
                out.append((UND, 0.0, 0))
                continue
            mean = gamma[at : at + n].sum(0, dtype=np.float64) / n
            at += n
            best = int(np.argmax(mean))
            out.append((self.model.labels[best], float(min(1.0, max(0.0, mean[best]))), n))
        return out


def label_languages(spark: SparkSession, docs: DataFrame, model: Model | None, keep: list[str], names: tuple[str, ...] = ("lang_pred", "score")) -> DataFrame:
    """The columns keep of docs, then the language of `text`, its score and, with a third name, its words under names
    (which must be free)."""
    shared = spark.sparkContext.broadcast(model)
    read = docs.select(*keep, *([] if "text" in keep else ["text"]))
    own = (F.lit(""), F.lit(0.0), F.lit(0).cast("long"))
    schema = docs.select(*keep, *(c.alias(x) for c, x in zip(own, names))).schema

    def run(batches):
        labeller = None if shared.value is None else Labeller(shared.value)
        for b in (part for whole in batches for part in slices(whole, most=2 << 20)):
            part = [(x or b"").decode(errors="replace") for x in b.column("text").cast(pa.binary()).to_pylist()]
            got: list[tuple[str, float, int]] = labeller.counted(part) if labeller is not None else [(UND, 0.0, 0)] * len(part)
            own = [pa.array([x[i] for x in got], kind) for i, kind in zip(range(len(names)), (pa.string(), pa.float64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *own], names=[*keep, *names])

    return mapped(read, run, schema)


def least_score(labels: int, words: Column) -> Column:
    """The score that tells the language of a text of so many words. Held-out texts of 20 words or fewer, with a foreign
    line, score little above 1 / labels; longer ones above 0.57 with four labels, while halves of two languages score a
    half and texts of other scripts less, the closer to chance the longer they are. A single label tells all."""
    chance = 1 / labels
    short, long = (0.0, 0.0) if labels == 1 else (chance + (1 - chance) / 15, max(0.55, chance + 0.4 * (1 - chance)))
    return F.lit(short) + F.least(F.greatest((words - 20) / 44, F.lit(0.0)), F.lit(1.0)) * (long - short)


def identified(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of docs whose language is told: not `und`, and with the least score for their length, so texts mixed of
    several languages or of none that was learned go, unless they are too short to tell."""
    model = trained(docs)
    own = tuple(free_names(docs, "language", "score", "words"))
    rows = label_languages(spark, docs, model, docs.columns, own)
    told = F.col(own[1]) >= least_score(len(model.labels) if model is not None else 1, F.col(own[2]))
    return rows.filter((F.col(own[0]) != UND) & told).drop(*own)


def languages(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row."""
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return label_languages(spark, rows, trained(docs), ["doc_id", "held_out"])
