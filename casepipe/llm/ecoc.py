"""Language identification with error-correcting output codes.

Every learned language has a codeword of bits; for each bit a binary
classifier over hashed byte n-grams (log-odds of the n-gram counts of the
languages whose bit is 1 against the others) predicts that bit.  Decoding
takes the codeword with the least loss, each bit weighted by how well its
classifier does on the training sample; a small lead over the second
codeword flags the answer as ambiguous.

Training reads a bounded sample: about ``PER_LANGUAGE`` labelled documents of
each language, chosen by a hash of the id, whole texts.  Prediction reads
whole texts of all documents and nothing but the text.

Defined cases: null text or text without letters is ``und`` with score 0;
rows with null ``lang`` or ``doc_id`` are not learned from; with one learned
language every text with letters gets it; with none all are ``und``; an empty
table gives no row; further columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casepipe.llm.common import flat, slabs, stored

#: Training documents of each language, about.
PER_LANGUAGE = 1500
#: Bytes of the table of language sizes that may be broadcast.
SIZES_BYTES = 1 << 23
#: Hash space of n-grams.
SIZE_BITS = 15
#: Codes of up to this many languages are exhaustive (every split in two).
EXHAUSTIVE = 6
#: Weight of the evidence in the loss: mean log-odds are multiplied by it.
SHARPNESS = 12.0
#: Least lead, as a share of probability, of an answer that is not ambiguous.
LEAD = 0.05
UNDECIDED = "und"
_letter = re.compile(r"[^\W\d_]")
#: Bytes as n-grams see them: lower-case letters, all beyond ASCII, blank otherwise.
SEEN = np.full(256, 0x20, np.uint8)
SEEN[0x61:0x7B] = np.arange(0x61, 0x7B)
SEEN[0x41:0x5B] = np.arange(0x61, 0x7B)
SEEN[0x80:] = np.arange(0x80, 0x100)


def codewords(k: int) -> np.ndarray:
    """``k`` rows of bits: all splits of a few languages, else pseudo-random
    columns, about ten times the logarithm of ``k``, that no two rows share."""
    if k <= 1:
        return np.zeros((k, 0), bool)
    if k <= EXHAUSTIVE:
        n = (1 << (k - 1)) - 1
        return np.array([[i == 0 or bool(j >> (i - 1) & 1) for j in range(n)] for i in range(k)])
    n = 10 * (k - 1).bit_length()
    rng = np.random.default_rng(17)
    best = max((rng.random((k, n)) < 0.5 for _ in range(50)), key=lambda c: min((c[i] != c[j]).sum() for i in range(k) for j in range(i)))
    return best[:, best.any(axis=0) & ~best.all(axis=0)]


def grams(raw: np.ndarray) -> np.ndarray:
    """Hash of the byte bigram and trigram that begin at each byte but the last two."""
    b = SEEN[raw].astype(np.uint32)
    two = b[:-2] << np.uint32(8) | b[1:-1]
    three = two << np.uint32(8) | b[2:]
    shift = np.uint32(32 - SIZE_BITS)
    return np.stack([(two * np.uint32(0x9E3779B1) + np.uint32(77)) >> shift, three * np.uint32(0x85EBCA6B) >> shift])


def _padded(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with a blank before and two after each, so that n-grams never cross."""
    n = len(at) - 1
    out = np.full(len(raw) + 3 * n, 0x20, np.uint8)
    start = at[:-1] + 3 * np.arange(n)
    shift = np.repeat(3 * np.arange(n) + 1, at[1:] - at[:-1])
    out[np.arange(len(raw)) + shift] = raw
    return out, np.append(start, len(out))


def _sums(raw: np.ndarray, at: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Mean weight of a text's n-grams, by classifier."""
    padded, start = _padded(raw, at)
    g = grams(padded)
    n = (start[1:] - start[:-1] - 2).astype(np.float64)
    first = np.minimum(start[:-1], g.shape[1] - 1)
    out = np.zeros((len(n), len(weights)))
    for j, w in enumerate(weights):
        out[:, j] = np.add.reduceat(w[g[0]] + w[g[1]], first) / n
    return out


class LanguageModel:
    """Codewords, classifiers and bit weights of the learned languages."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = sorted(counts)
        self.code = codewords(len(self.languages))
        rows = np.array([counts[x] for x in self.languages], np.float64).reshape(len(self.languages), 1 << SIZE_BITS)
        share = (rows + 0.1) / (rows + 0.1).sum(axis=1, keepdims=True) if len(rows) else rows
        weights = [np.log(share[bit].mean(axis=0)) - np.log(share[~bit].mean(axis=0)) for bit in self.code.T]
        self.weights = np.array(weights, np.float32).reshape(-1, 1 << SIZE_BITS)
        self.bit_weight = np.ones(len(self.weights))

    def margins(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        return _sums(raw, at, self.weights)

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(language number, score, ambiguous)`` of each row of margins."""
        k = len(self.languages)
        if k == 1:
            n = len(margins)
            return np.zeros(n, int), np.ones(n), np.zeros(n, bool)
        sign = np.where(self.code, 1.0, -1.0)
        loss = np.zeros((len(margins), k))
        for j in range(len(self.weights)):
            loss += self.bit_weight[j] * np.logaddexp(0, -SHARPNESS * margins[:, j : j + 1] * sign[None, :, j])
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        top = np.sort(p, axis=1)
        return best, top[:, -1], top[:, -1] - top[:, -2] < LEAD


def held_out(c: str = "doc_id") -> Column:
    """True for the documents that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(c).cast("string")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Model of the languages of ``docs(doc_id, text, lang)``.

    What reaches the driver is one count vector and one row of bit errors per language.
    """
    usable = F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out()
    labelled = docs.where(usable)
    sizes = stored(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("size")), "language-sizes")
    if (sizes.agg(F.sum(F.octet_length("lang") + 16)).first()[0] or 0) <= SIZES_BYTES:
        sizes = F.broadcast(sizes)  # only the sampled texts are dealt out then
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = stored(labelled.select("doc_id", "lang", "text").join(sizes, "lang").where(draw < per_language / F.col("size")).select("lang", "text").repartition("lang"), "language-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, np.ndarray] = {}
        for b in batches:
            raw, at = flat(b.column(1))
            langs = b.column(0).to_pylist()
            for i, lang in enumerate(langs):
                padded, _ = _padded(raw[at[i] : at[i + 1]], np.array([0, at[i + 1] - at[i]]))
                c = np.bincount(grams(padded).ravel(), minlength=1 << SIZE_BITS)
                out[lang] = out[lang] + c if lang in out else c
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array([c.astype("<i8").tobytes() for c in out.values()], pa.binary())], names=["lang", "counts"])

    counts: dict[str, np.ndarray] = {}
    for row in sample.mapInArrow(count, "lang string, counts binary").collect():
        c = np.frombuffer(row["counts"], "<i8")
        counts[row["lang"]] = counts.get(row["lang"], 0) + c
    model = LanguageModel(counts)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            raw, at = flat(b.column(1))
            want = m.code[[m.languages.index(x) for x in b.column(0).to_pylist()]]
            for lo, hi in slabs(at):
                wrong = ((m.margins(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]) > 0) != want[lo:hi]).sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(range(len(wrong)), pa.int32()), pa.array(wrong, pa.int64()), pa.array([hi - lo] * len(wrong), pa.int64())], names=["bit", "wrong", "n"])

    if len(model.weights):
        told = sample.mapInArrow(errors, "bit int, wrong long, n long").groupBy("bit").agg(F.sum("wrong").alias("wrong"), F.sum("n").alias("n")).collect()
        for row in told:
            e = (row["wrong"] + 1) / (row["n"] + 2)
            model.bit_weight[row["bit"]] = max(0.05, 0.5 * np.log((1 - min(e, 0.45)) / min(e, 0.45)))
        model.bit_weight /= model.bit_weight.mean()
    return model


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``lang_score`` and ``lang_ambiguous``
    (columns of these names are replaced)."""
    spark = docs.sparkSession
    docs = docs.drop("lang_pred", "lang_score", "lang_ambiguous")
    shared = spark.sparkContext.broadcast(model)
    names = [*docs.columns, "lang_pred", "lang_score", "lang_ambiguous"]
    schema = T.StructType(list(docs.schema.fields)).add("lang_pred", "string").add("lang_score", "double").add("lang_ambiguous", "boolean")
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            column = b.column(place)
            raw, at = flat(column)
            pred: list[str] = []
            score: list[float] = []
            vague: list[bool] = []
            for lo, hi in slabs(at):
                if m.languages:
                    best, p, unsure = m.decode(m.margins(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]))
                for i in range(lo, hi):
                    if not m.languages or not _letter.search(column[i].as_py() or ""):
                        pred.append(UNDECIDED)
                        score.append(0.0)
                        vague.append(True)
                    else:
                        pred.append(m.languages[best[i - lo]])
                        score.append(float(p[i - lo]))
                        vague.append(bool(unsure[i - lo]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(vague, pa.bool_())], names=names)

    return docs.mapInArrow(run, schema)
