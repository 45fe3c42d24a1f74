"""Language-model scores of texts from a log-bilinear model trained with noise-contrastive estimation.

The model predicts classes: each of the most frequent words is a class of its own, every other word belongs to a tail
class by its ending. Inside a tail class words follow their smoothed counts, so the probabilities of all words and of
one unknown word per tail class sum to 1. Counts are those of all training tokens, and every training token is learned
from: each task trains a copy of the model on its rows, and copies are averaged, weighted by tokens, after each pass.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmine.llm.common import as_bytes, fold, pieces
from shelfmine.session import cut_lineage

FOLDS = 10
SMOOTHING = 0.1
# no word holds white space, so this cannot be one
END = b"\n"
# frequent words that every task knows, so that only the others are looked up by a join; longer ones are not sent
HOT_WORDS = 100_000
HOT_BYTES = 64
# steps of the histogram of counts for each doubling
LEVELS = 16
SHORTLIST = 384
TAIL = 128
WIDTH = 24
NOISE = 48
BATCH = 2_048
# tokens of a task that are brought together before it steps over them
CHUNK = 2_000_000
# of the class streams that are unpacked at a time
STREAM_BYTES = 1024 * 1024
PASSES = 2
RATE = 0.1
# words counted or remembered by a task before it passes them on
MEMORY_WORDS = 300_000

CLASSES = SHORTLIST + TAIL


def tail_class(word: bytes) -> int:
    return SHORTLIST + zlib.crc32(word[-2:]) % TAIL


@dataclass
class Vocabulary:
    """What every task knows: frequent words with class and count, and the mass of each tail class.

    The end token is always the first word, and class 0.
    """

    place: dict[bytes, int]
    classes: np.ndarray
    counts: np.ndarray
    mass: np.ndarray  # of the known words of each class, smoothed
    tokens: int
    types: int

    def shares(self) -> np.ndarray:
        """Class probabilities without context; tail classes hold an unknown word each."""
        mass = self.mass + np.where(np.arange(CLASSES) >= SHORTLIST, SMOOTHING, 0.0)
        return mass / mass.sum()

    @property
    def tail_mass(self) -> np.ndarray:
        return self.mass + SMOOTHING


class Reader:
    """Turns texts into class ids and places among the frequent words (-1: none)."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.classes = np.r_[vocabulary.classes, np.arange(SHORTLIST, CLASSES)]
        self.first_tail = len(vocabulary.classes)
        self.rest: dict[bytes, int] = {}

    def read(self, words: list[bytes]) -> np.ndarray:
        """Places; a word outside the frequent ones has the place of its tail class behind them."""
        found = list(map(self.vocabulary.place.get, words))
        if None in found:
            rest = self.rest
            if len(rest) > MEMORY_WORDS:
                rest.clear()
            for i, x in enumerate(found):
                if x is None:
                    word = words[i]
                    if (x := rest.get(word)) is None:
                        x = rest[word] = self.first_tail + tail_class(word) - SHORTLIST
                    found[i] = x
        return np.array(found, dtype=np.int64)

    def stream(self, texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
        """Words of each text, places of all tokens with the end tokens, and the bounds of the texts."""
        docs = [t.lower().split() for t in texts]
        bounds = np.cumsum([0, *(len(d) + 1 for d in docs)])
        places = self.read([w for d in docs for w in (*d, END)])
        return docs, places, bounds


def contexts(classes: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The two classes before each token; before a text stands an end token."""
    one, two = np.r_[end, classes[:-1]], np.r_[end, end, classes[:-2]]
    starts = bounds[:-1]
    one[starts] = end
    two[starts] = end
    second = starts + 1
    two[second[second < len(two)]] = end
    return one, two[: len(one)]


@dataclass
class Model:
    """Score of class w after classes u (last) and v: (c1 * R[u] + c2 * R[v]) . Q[w] + b[w]."""

    q: np.ndarray
    b: np.ndarray
    r: np.ndarray
    c: np.ndarray

    @classmethod
    def start(cls, shares: np.ndarray) -> Model:
        rng = np.random.default_rng(7)
        small = lambda: (rng.standard_normal((CLASSES, WIDTH)) * 0.1).astype(np.float32)
        return cls(small(), np.log(shares).astype(np.float32), small(), np.ones((2, WIDTH), np.float32))

    def rows(self) -> list[list[float]]:
        """One row of numbers per class, and one for the context weights."""
        body = np.c_[self.q, self.b, self.r].astype(float)
        return [*body.tolist(), [*self.c.astype(float).ravel().tolist(), 0.0]]

    @classmethod
    def of_rows(cls, rows: np.ndarray) -> Model:
        m = rows.astype(np.float32)
        body = m[:CLASSES]
        return cls(
            body[:, :WIDTH].copy(), body[:, WIDTH].copy(), body[:, WIDTH + 1 :].copy(), m[CLASSES, : 2 * WIDTH].reshape(2, WIDTH)
        )


def summed(rows: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Sum of the rows of each id."""
    order = np.argsort(at, kind="stable")
    ids = at[order]
    first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    out = np.zeros((size, rows.shape[1]), np.float32)
    out[ids[first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


class Trainer:
    """Noise-contrastive estimation with noise from the class shares, shared by a batch; Adagrad steps."""

    def __init__(self, model: Model, shares: np.ndarray) -> None:
        self.m = model
        self.shares = shares
        self.log_noise = np.log(NOISE * shares).astype(np.float32)
        self.rng = np.random.default_rng(11)
        self.squares = [np.full(x.shape, 1e-3, np.float32) for x in (model.q, model.b, model.r, model.c)]
        self.tokens = 0

    def learn(self, trigrams: np.ndarray) -> None:
        """Steps over all tokens, given as (class, last class, class before) in one number; equal ones are one row with
        a weight."""
        seen, weight = np.unique(trigrams, return_counts=True)
        order = self.rng.permutation(len(seen))
        seen, weight = seen[order], weight[order].astype(np.float32)
        for a in range(0, len(seen), BATCH):
            part = seen[a : a + BATCH]
            pair = part % (CLASSES * CLASSES)
            self.step(part // (CLASSES * CLASSES), pair // CLASSES, pair % CLASSES, weight[a : a + BATCH])

    def step(self, w: np.ndarray, u: np.ndarray, v: np.ndarray, weight: np.ndarray) -> None:
        m, n = self.m, weight.sum()
        noise = self.rng.choice(CLASSES, NOISE, p=self.shares)
        ru, rv = m.r[u], m.r[v]
        h = m.c[0] * ru + m.c[1] * rv
        qw, qn = m.q[w], m.q[noise]
        true = (h * qw).sum(1) + m.b[w] - self.log_noise[w]
        false = h @ qn.T + (m.b[noise] - self.log_noise[noise])
        g = weight / (1 + np.exp(np.clip(true, -30, 30)))
        gn = -weight[:, None] / (1 + np.exp(-np.clip(false, -30, 30)))
        dh = g[:, None] * qw + gn @ qn
        dq = summed(np.c_[g[:, None] * h, g], w, CLASSES)
        np.add.at(dq, noise, np.c_[gn.T @ h, gn.sum(0)])
        dr = summed(m.c[0] * dh, u, CLASSES) + summed(m.c[1] * dh, v, CLASSES)
        dc = np.stack([(ru * dh).sum(0), (rv * dh).sum(0)])
        for x, d, s in zip((m.q, m.b, m.r, m.c), (dq[:, :-1], dq[:, -1], dr, dc), self.squares):
            d = d / n
            s += d * d
            x += RATE * d / np.sqrt(s)
        self.tokens += int(n)


def streams(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Classes of all tokens, and the bounds of the texts, for some texts at a time."""
    for codes in pieces(column.to_pylist(), STREAM_BYTES):
        bounds = np.cumsum([0, *(len(c) // 2 for c in codes)])
        yield np.frombuffer(b"".join(codes), dtype="<i2").astype(np.int64), bounds


def train(codes: DataFrame, model: Model, shares: np.ndarray) -> Model:
    """One pass over all training tokens, in every task from ``model``; the average of what the tasks reached."""
    shared = codes.sparkSession.sparkContext.broadcast(model)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = shared.value
        trainer = Trainer(Model(start.q.copy(), start.b.copy(), start.r.copy(), start.c.copy()), shares)
        held: list[np.ndarray] = []
        for batch in batches:
            for w, bounds in streams(batch.column(0)):
                u, v = contexts(w, bounds, 0)
                held.append(((w * CLASSES + u) * CLASSES + v).astype(np.int32))
                if sum(map(len, held)) > CHUNK:
                    trainer.learn(np.concatenate(held))
                    held = []
        if held:
            trainer.learn(np.concatenate(held))
        if trainer.tokens:
            rows = trainer.m.rows()
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.list_(pa.float64())), pa.array([float(trainer.tokens)] * len(rows))],
                names=["row", "numbers", "weight"],
            )

    size = 2 * WIDTH + 1
    reached = codes.mapInArrow(learn, "row int, numbers array<double>, weight double").groupBy("row").agg(
        F.sum("weight").alias("weight"), *(F.sum(F.col("numbers")[i] * F.col("weight")).alias(f"n{i}") for i in range(size))
    )
    # one row per class, whatever the input
    rows = sorted(reached.collect())
    if not rows:
        return model
    return Model.of_rows(np.array([[r[f"n{i}"] / r["weight"] for i in range(size)] for r in rows]))


def word_counts(texts: DataFrame) -> DataFrame:
    """``(word, n)`` of all tokens, end tokens included. Tasks add up before the shuffle, within bounded memory."""

    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "n"]
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in as_bytes(batch.column(0)):
                counts.update(text.lower().split())
                counts[END] += 1
                if len(counts) > MEMORY_WORDS:
                    yield rows(counts)
                    counts = Counter()
        yield rows(counts)

    return texts.mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary_of(counts: DataFrame) -> Vocabulary:
    """The bounded part of the counts: frequent words, sums by class, totals."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    # frequent words are those above a count that at most HOT_WORDS reach: a histogram of counts finds it, so no task
    # sends its own list of candidates
    usable = counts.where((F.length("word") <= HOT_BYTES) & (F.col("word") != F.lit(END))).withColumn(
        "level", F.floor(F.log2(F.col("n").cast("double")) * LEVELS)
    )
    sizes = {r["level"]: r["v"] for r in usable.groupBy("level").agg(F.count(F.lit(1)).alias("v")).collect()}
    least, reached = None, 0
    for level in sorted(sizes, reverse=True):
        reached += sizes[level]
        if reached > HOT_WORDS:
            break
        least = level
    top = usable.where(F.col("level") >= least).collect() if least is not None else []
    top.sort(key=lambda r: (-r["n"], bytes(r["word"])))
    ends = counts.where(F.col("word") == F.lit(END)).collect()
    words = [END, *(bytes(r["word"]) for r in top)]
    n = np.array([ends[0]["n"] if ends else 0, *(r["n"] for r in top)], dtype=np.int64)
    short = set(words[:SHORTLIST])

    def by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass = np.zeros(CLASSES)
        for batch in batches:
            for word, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if word not in short:
                    mass[tail_class(word)] += count + SMOOTHING
        yield pa.RecordBatch.from_arrays([pa.array(range(CLASSES), pa.int32()), pa.array(mass)], names=["class", "mass"])

    mass = np.zeros(CLASSES)
    for r in counts.mapInArrow(by_class, "class int, mass double").groupBy("class").agg(F.sum("mass").alias("mass")).collect():
        mass[r["class"]] = r["mass"]
    mass[: len(short)] = n[: len(short)] + SMOOTHING
    mass[len(short) : SHORTLIST] = 1e-9  # a shortlist that is not full has classes without words
    classes = [i if i < SHORTLIST else tail_class(w) for i, w in enumerate(words)]
    return Vocabulary({w: i for i, w in enumerate(words)}, np.array(classes), n, mass, int(total["n"]), int(total["v"]))


class Scorer:
    """Log10 probabilities of classes. The normaliser of each pair of context classes is computed once per task."""

    def __init__(self, model: Model) -> None:
        self.m = model
        self.normaliser = np.full(CLASSES * CLASSES, np.nan, dtype=np.float32)

    def hidden(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        return self.m.c[0] * self.m.r[u] + self.m.c[1] * self.m.r[v]

    def prepare(self, pairs: np.ndarray) -> None:
        new = np.zeros(CLASSES * CLASSES, dtype=bool)
        new[pairs] = True
        missing = np.flatnonzero(new & np.isnan(self.normaliser))
        for a in range(0, len(missing), 4_096):
            some = missing[a : a + 4_096]
            logits = self.hidden(some // CLASSES, some % CLASSES) @ self.m.q.T + self.m.b
            most = logits.max(1)
            self.normaliser[some] = most + np.log(np.exp(logits - most[:, None]).sum(1))

    def log10(self, w: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        pairs = u * CLASSES + v
        self.prepare(pairs)
        out = np.empty(len(w))
        for a in range(0, len(w), 65_536):
            s = slice(a, a + 65_536)
            out[s] = (self.hidden(u[s], v[s]) * self.m.q[w[s]]).sum(1) + self.m.b[w[s]] - self.normaliser[pairs[s]]
        return out / math.log(10)


ENCODED = (
    "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, inside double, "
    "words array<binary>, times array<bigint>, codes binary"
)


def encoded(rows: DataFrame, vocabulary) -> DataFrame:
    """Per row: the classes of its tokens, sums over the frequent words, and the other words with their counts."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary.value
        reader = Reader(vocab)
        first_tail = reader.first_tail
        own = np.r_[np.log10(vocab.counts + SMOOTHING), np.zeros(TAIL)]
        # of a word in its class: its own part comes from the counts, the class's part is known here
        inside = np.where(reader.classes < SHORTLIST, 0.0, own - np.log10(vocab.tail_mass[reader.classes]))
        known = np.r_[vocab.counts > 0, np.zeros(TAIL, dtype=bool)]
        whole = math.log10(vocab.tokens + SMOOTHING * (vocab.types + 1))
        for batch in batches:
            done = 0
            for piece in pieces(as_bytes(batch.column(1))):
                docs, places, bounds = reader.stream(piece)
                add = lambda x: np.add.reduceat(x, bounds[:-1])
                n = np.diff(bounds)
                rare = [
                    Counter(doc[i] for i in np.flatnonzero(places[a : b - 1] >= first_tail))
                    for doc, a, b in zip(docs, bounds, bounds[1:])
                ]
                raw = reader.classes[places].astype("<i2").tobytes()
                ids = batch.column(0).slice(done, len(piece))
                done += len(piece)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array(n, pa.int64()),
                        pa.array(add(known[places].astype(np.int64)), pa.int64()),
                        pa.array(add(own[places]) - n * whole, pa.float64()),
                        pa.array(add(inside[places]), pa.float64()),
                        pa.array([list(c.keys()) for c in rare], pa.list_(pa.binary())),
                        pa.array([list(c.values()) for c in rare], pa.list_(pa.int64())),
                        pa.array([raw[2 * a : 2 * b] for a, b in zip(bounds, bounds[1:])], pa.binary()),
                    ],
                    names=[c.split()[0] for c in ENCODED.split(", ")],
                )

    return rows.mapInArrow(encode, ENCODED).withColumn("row", F.monotonically_increasing_id())


def class_scores(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` with ``logs`` in place of ``codes``: the sum of the log10 probabilities of the tokens' classes."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in rows.columns if c != "codes"]
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            done = 0
            for w, bounds in streams(batch.column("codes")):
                part = batch.slice(done, len(bounds) - 1)
                done += len(bounds) - 1
                logs = np.add.reduceat(scorer.log10(w, *contexts(w, bounds, 0)), bounds[:-1])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(logs)], names=[*kept, "logs"])

    return rows.select(*kept, "codes").mapInArrow(score, f"{kinds}, logs double")


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, passes: int = PASSES) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``, one row per input row.

    Null and empty texts hold the end token only. Repeated rows count and are scored like others; a null id belongs to
    the fold of the text "null". An empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    training = fold(F.col("doc_id"), folds) != 0
    counts = cut_lineage(word_counts(rows.where(training).select("text")), "words")
    vocabulary = vocabulary_of(counts)
    # texts are read once into classes; the numbers of the rows are kept with them, so a lost task cannot change them
    coded = cut_lineage(encoded(rows, docs.sparkSession.sparkContext.broadcast(vocabulary)), "codes")
    shares = vocabulary.shares()
    model = Model.start(shares)
    for _ in range(passes):
        model = train(coded.where(training).select("codes"), model, shares)
    rest = coded.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", "w.words", "w.times")
    found = rest.join(counts, rest["words"] == counts["word"], "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(SMOOTHING))).alias("own"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known"),
    )
    own = F.coalesce("own", F.lit(0.0))
    made = class_scores(coded.select("row", "doc_id", "n_tokens", "n_known", "base_score", "inside", "codes"), model)
    return made.join(found, "row", "left").select(
        "doc_id",
        (~training).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + own).alias("base_score"),
        (F.col("logs") + F.col("inside") + own).alias("score"),
    )
