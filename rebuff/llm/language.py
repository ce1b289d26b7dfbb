"""Language identification by a linear-chain conditional random field over words.

Words are runs of letters; a line is a sequence. A word's emission score for a language is the sum of
hashed weights of its affixes and character n-grams (2 to 4 characters of the word between boundary marks, so
those that touch a mark are its affixes) and of its lexicon entry; transitions between neighbouring words
are learned with them. Forward-backward gives every word's posterior, so code-switched text is labelled
word by word; a document's language is that of the largest mean posterior, which is its score.

Training takes whole texts of about ``PER_LANGUAGE`` documents of each language, chosen by a hash of the id
among the documents not held out; some of their lines are joined to lines of another language, so that
transitions see switches. The ``MAX_LANGUAGES`` languages with the most labelled documents are learned, so ``BUCKETS``
and this bound fix the model's size, which the driver and every task hold.

Defined cases: null text, or one without letters, is ``und`` with score 0; without labelled rows all are
``und``; only ``keep`` and the results are returned; rows that repeat an id are treated one by one; an empty table
gives no rows; equal posteriors go to the first language in order. Letters are of the Unicode categories L.
"""
from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rebuff.llm.common import materialize

BUCKETS = 1 << 16
#: The documented bound of the training sample: documents of each language, in expectation.
PER_LANGUAGE = 150
MAX_LANGUAGES = 128
EPOCHS = 4
RATE = 0.5
SWITCHED = 0.25
CHUNK_CHARS = 1 << 20
CACHE = 400_000
#: Number signs beyond decimal digits, which the class of word characters holds although they are no letters.
_NUMBERS = "".join(c for c in map(chr, range(0x110000)) if c.isnumeric() and unicodedata.category(c) in ("Nl", "No"))
_RUNS = re.compile(r"[^\W\d_]+").findall
_LETTERS = re.compile(rf"[^\W\d_{_NUMBERS}]+").findall


def words_of(line: str) -> list[str]:
    """Runs of letters. The long class is slow, so only runs that hold something else go through it."""
    found = _RUNS(line)
    return found if not found or "".join(found).isalpha() else [x for w in found for x in ([w] if w.isalpha() else _LETTERS(w))]


def held_out(key: Column) -> Column:
    return F.crc32(F.encode(key.cast("string"), "UTF-8")) % 3 == 1


def features(vocabulary: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(weight row, word) of every feature of every word."""
    marked = "".join(["\x02" + w + "\x03" for w in vocabulary])
    code = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.cumsum(code == 2) - 1
    rows, owners = [], []
    h = code
    for n in (2, 3, 4):
        h = (h[:-1] * np.uint64(1_000_003) + code[n - 1:] * np.uint64(0x9E3779B1)) ^ (h[:-1] >> np.uint64(23))
        ok = word[:len(h)] == word[n - 1:]
        x = h[ok]
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
        rows.append((x % np.uint64(buckets)).astype(np.int64) + (n - 1) * buckets)
        owners.append(word[:len(h)][ok])
    rows.append(np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % buckets for w in vocabulary), np.int64, len(vocabulary)))
    owners.append(np.arange(len(vocabulary)))
    return np.concatenate(rows), np.concatenate(owners)


def emissions(vocabulary: list[str], weights: np.ndarray) -> np.ndarray:
    """(words, languages): exponentials of the scores, scaled to a row maximum of 1."""
    rows, owners = features(vocabulary, len(weights) // 4)
    total = np.stack([np.bincount(owners, weights[rows, k], len(vocabulary)) for k in range(weights.shape[1])], 1)
    return np.exp(total - total.max(axis=1, keepdims=True))


def posteriors(emit: np.ndarray, lengths: np.ndarray, transition: np.ndarray, counts: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over many sequences at once. ``emit`` holds their words one after the other.

    Returns every word's posterior, and the expected transition counts if ``counts``. Sequences are taken longest first, so
    position t of all that reach it is one prefix.
    """
    n = len(lengths)
    order = np.argsort(-lengths, kind="stable")
    start = (np.cumsum(lengths) - lengths)[order]
    longest = int(lengths.max(initial=0))
    reach = np.searchsorted(-lengths[order], -np.arange(longest), side="left")   # sequences longer than t
    alpha = np.empty_like(emit)
    for t in range(longest):
        m = reach[t]
        at = start[:m] + t
        a = emit[at] * (alpha[at - 1] @ transition) if t else emit[at].copy()
        alpha[at] = a / a.sum(axis=1, keepdims=True)
    expected = np.zeros_like(transition)
    out = alpha
    beta = np.ones((n, emit.shape[1]))
    later = beta[:reach[longest - 1]].copy() if longest else beta
    for t in reversed(range(longest - 1)):
        m = reach[t + 1]
        at = start[:m] + t
        b = emit[at + 1] * beta[:m]
        if counts:
            joint = alpha[at][:, :, None] * transition[None] * b[:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            expected += joint.sum(axis=0)
        beta[:m] = b @ transition.T
        beta[:m] /= beta[:m].sum(axis=1, keepdims=True)
        # Positions from t + 1 on are finished; alpha at t is not read again after this step.
        _finish(out, start, reach, t + 1, later)
        later = beta[:reach[t]].copy()
    if longest:
        _finish(out, start, reach, 0, later)
    return out, expected


def _finish(alpha: np.ndarray, start: np.ndarray, reach: np.ndarray, t: int, beta: np.ndarray) -> None:
    at = start[:reach[t]] + t
    g = alpha[at] * beta[:reach[t]]
    alpha[at] = g / g.sum(axis=1, keepdims=True)


def train(texts: list[str], labels: list[int], n_labels: int, buckets: int = BUCKETS, epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(weights, transition): Adagrad on the conditional likelihood, in minibatches of lines."""
    vocabulary: dict[str, int] = {}
    lines = [([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(line.lower())], y) for t, y in zip(texts, labels) for line in t.split("\n")]
    lines = [x for x in lines if x[0]]
    rng = np.random.default_rng(seed)
    mixed = []
    for k in np.flatnonzero(rng.random(len(lines)) < SWITCHED).tolist():
        (a, y), (b, z) = lines[k], lines[int(rng.integers(len(lines)))]
        mixed.append((a + b, [y] * len(a) + [z] * len(b)))
    sequences = [(np.array(w), np.full(len(w), y)) for w, y in lines] + [(np.array(w), np.array(y)) for w, y in mixed]
    rows, owners = features(list(vocabulary), buckets)
    by = np.argsort(owners, kind="stable")
    rows, cuts = rows[by], np.searchsorted(owners[by], np.arange(len(vocabulary) + 1))
    weights, seen = np.zeros((4 * buckets, n_labels)), np.full((4 * buckets, n_labels), 1e-2)
    trans, t_seen = np.zeros((n_labels, n_labels)), np.full((n_labels, n_labels), 1e-2)
    for _ in range(epochs):
        order = rng.permutation(len(sequences))
        for at in range(0, len(order), 256):
            part = [sequences[i] for i in order[at:at + 256].tolist()]
            w, y = np.concatenate([p[0] for p in part]), np.concatenate([p[1] for p in part])
            lengths = np.array([len(p[0]) for p in part])
            words, inverse = np.unique(w, return_inverse=True)
            size = cuts[words + 1] - cuts[words]
            flat = rows[np.repeat(cuts[words] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            own = np.repeat(np.arange(len(words)), size)
            score = np.stack([np.bincount(own, weights[flat, k], len(words)) for k in range(n_labels)], 1)[inverse]
            post, expected = posteriors(np.exp(score - score.max(axis=1, keepdims=True)), lengths, np.exp(trans))
            miss = -post
            miss[np.arange(len(y)), y] += 1
            per_word = np.stack([np.bincount(inverse, miss[:, k], len(words)) for k in range(n_labels)], 1) / len(w)
            touched, back = np.unique(flat, return_inverse=True)
            g = np.stack([np.bincount(back, per_word[own, k], len(touched)) for k in range(n_labels)], 1)
            seen[touched] += g * g
            weights[touched] += rate * g / np.sqrt(seen[touched])
            ends = np.cumsum(lengths)
            inner = np.setdiff1d(np.arange(len(y) - 1), ends - 1)
            gold = np.bincount(y[inner] * n_labels + y[inner + 1], minlength=n_labels * n_labels).reshape(n_labels, n_labels)
            tg = (gold - expected) / len(w)
            t_seen += tg * tg
            trans += rate * tg / np.sqrt(t_seen)
    return weights.astype(np.float32), np.exp(trans)


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, max_languages: int = MAX_LANGUAGES) -> tuple[list[str], np.ndarray, np.ndarray] | None:
    """(languages, weights, transition), trained in one task on the bounded sample; None without labels."""
    known = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~F.coalesce(held_out(F.col(key)), F.lit(True)))
    counts = materialize(known.groupBy("l").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l").limit(max_languages), "languages")
    span = 1 << 30
    chosen = known.join(F.broadcast(counts.withColumnRenamed("l", "c_l")), F.col("l") == F.col("c_l")).where(
        F.pmod(F.xxhash64("k"), F.lit(span)) * F.col("n") <= F.lit(per_language * span))
    sample = chosen.groupBy(F.lit(1).alias("one")).applyInArrow(_train_task, "langs array<string>, weights binary, transition binary")
    row = sample.first()
    if row is None:
        return None
    n = len(row["langs"])
    return list(row["langs"]), np.frombuffer(row["weights"], np.float32).reshape(-1, n), np.frombuffer(row["transition"], np.float64).reshape(n, n)


def _train_task(t: pa.Table) -> pa.Table:
    rows = sorted(zip(t.column("k").to_pylist(), t.column("t").to_pylist(), t.column("l").to_pylist()))
    langs = sorted({r[2] for r in rows})
    number = {x: i for i, x in enumerate(langs)}
    weights, transition = train([r[1] for r in rows], [number[r[2]] for r in rows], len(langs))
    return pa.table({"langs": pa.array([langs], pa.list_(pa.string())), "weights": pa.array([weights.tobytes()], pa.binary()), "transition": pa.array([transition.tobytes()], pa.binary())})


def predict(docs: DataFrame, model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` plus ``lang_pred``, ``score`` and ``mix`` (mean posterior of every language), one row per input row."""
    langs, weights, transition = model if model else ([], np.zeros((4, 1), np.float32), np.ones((1, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: dict[str, int] = {}
        rows = np.empty((0, max(1, len(langs))))
        for batch in batches:
            at = 0
            column = batch.column(len(keep))
            while at < batch.num_rows:
                texts, size = [], 0
                while at + len(texts) < batch.num_rows and size < CHUNK_CHARS:
                    texts.append(column[at + len(texts)].as_py())
                    size += len(texts[-1] or "")
                if len(index) > CACHE:
                    index, rows = {}, rows[:0]
                words, lengths, owner = [], [], []
                for d, x in enumerate(texts):
                    for line in (x or "").lower().split("\n") if langs else ():
                        found = words_of(line)
                        if found:
                            words += found
                            lengths.append(len(found))
                            owner.append(d)
                new = list(dict.fromkeys([w for w in words if w not in index]))
                if new:
                    index.update(zip(new, range(len(index), len(index) + len(new))))
                    rows = np.concatenate([rows, emissions(new, weights)])
                total = np.zeros((len(texts), max(1, len(langs))))
                if words:
                    emit = rows[np.fromiter(map(index.__getitem__, words), np.int64, len(words))]
                    sizes = np.array(lengths)
                    post, _ = posteriors(emit, sizes, transition, counts=False)
                    doc = np.repeat(np.array(owner), sizes)
                    total = np.stack([np.bincount(doc, post[:, k], len(texts)) for k in range(post.shape[1])], 1)
                count = total.sum(axis=1)
                mean = total / np.maximum(count, 1e-300)[:, None]
                best = mean.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([
                    *[c.slice(at, len(texts)) for c in batch.columns[:len(keep)]],
                    pa.array([langs[k] if n > 0 else "und" for k, n in zip(best.tolist(), count.tolist())], pa.string()),
                    pa.array(np.clip(np.where(count > 0, mean.max(axis=1), 0.0), 0.0, 1.0)),
                    pa.array([dict(zip(langs, m)) if n > 0 else {} for m, n in zip(mean.tolist(), count.tolist())], pa.map_(pa.string(), pa.float64()))],
                    [*keep, "lang_pred", "score", "mix"])
                at += len(texts)
    d = docs.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[:-1])
    return d.mapInArrow(run, f"{schema}, lang_pred string, score double, mix map<string,double>")
