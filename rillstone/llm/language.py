"""Operator 8, language ID: a linear-chain conditional random field over the words of a text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytehash import RangeHash, mix, spans
from .common import durable, flat_bytes, held_out, sized_join, text_slices, train_fold

BUCKETS_LOG2 = 17
#: The model learns from about this many rows of the training fold, as many of each language, those
#: with the smallest hashes of their ids ...
SAMPLE_ROWS = 2000
#: ... but from so many rows of a language if it has them, so that with many languages none goes without.
LEAST_ROWS = 20
#: Only texts of at most so many characters are learned from, which bounds the sample's bytes; a language
#: that has none but longer ones learns from these, cut.
SAMPLE_CHARS = 20_000
#: Words that are scored at a time, and the words of a block in forward-backward.
GROUP_WORDS = 1 << 20
BLOCK = 256
UNDETERMINED = "und"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[65:91] = _WORD[97:123] = True
_WORD[0x80:] = True


def word_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of each word; the features' buckets and the words they belong to, sorted by word.

    Features: the word itself (lexicon), prefixes and suffixes of 1 to 3 bytes (affixes), and
    2- to 4-byte n-grams within it.
    """
    folded = _LOWER[data]
    start, end = spans(_WORD[data], offsets)
    row = np.searchsorted(offsets, start, "right") - 1
    n = len(start)
    if not n:
        return row, np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = end - start
    every = np.arange(n)
    # 1 to 4 bytes from each place, packed into one number
    packed = [folded.astype(np.uint64)]
    for k in (1, 2, 3):
        packed.append((packed[-1][: len(data) - k] << np.uint64(8)) | packed[0][k:])
    kind = lambda x, k: x | np.uint64(k << 40)
    keys, words = [RangeHash(folded)(start, end)], [every]
    for k in (1, 2, 3):
        has = np.flatnonzero(size > k)
        keys += [kind(packed[k - 1][start[has]], 10 + k), kind(packed[k - 1][end[has] - k], 20 + k)]
        words += [has, has]
    for k in (2, 3, 4):
        times = np.maximum(size - k + 1, 0)
        which = np.repeat(every, times)
        at = np.arange(len(which)) + np.repeat(start - np.cumsum(times) + times, times)
        keys.append(kind(packed[k - 1][at], 30 + k))
        words.append(which)
    bucket = (mix(np.concatenate(keys)) >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int64)
    return row, bucket, np.concatenate(words)


@dataclass
class Crf:
    languages: list[str]
    #: (used buckets + 1, languages): a feature's score for each label; the first row, zeros, is for buckets that weren't learned.
    emission: np.ndarray
    #: (languages, languages): score of a label after another; and of a first label.
    transition: np.ndarray
    first: np.ndarray
    #: (2**BUCKETS_LOG2): the row of each bucket.
    place: np.ndarray

    def word_scores(self, n: int, bucket: np.ndarray, word: np.ndarray) -> np.ndarray:
        bucket = self.place[bucket]
        return np.stack([np.bincount(word, self.emission[bucket, k], n) for k in range(len(self.languages))], 1)


def marginals(scores: np.ndarray, lengths: np.ndarray, transition: np.ndarray, first: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Posterior label probabilities of all words of sequences that lie one after another.

    Forward-backward, exact for any length: each sequence is cut into blocks; the products of a
    block's transition matrices give the messages between blocks, and all blocks of all
    sequences then run side by side. Empty sequences have no words and need none.
    """
    lengths = lengths[lengths > 0]
    labels = scores.shape[1]
    emit = np.exp(scores - scores.max(1, keepdims=True)) + 1e-30
    trans, start = np.exp(transition - transition.max()), np.exp(first - first.max())
    counts = -(-lengths // block)
    owner = np.repeat(np.arange(len(lengths)), counts)
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = np.repeat(np.cumsum(lengths) - lengths, counts) + rank * block
    size = np.minimum(block, np.repeat(lengths, counts) - rank * block)
    by_size = np.argsort(-size, kind="stable")
    inverse = np.argsort(by_size)
    begin, size, rank = begin[by_size], size[by_size], rank[by_size]
    active = [int(np.searchsorted(-size, -t, "left")) for t in range(int(size.max()))]  # blocks with more than t words

    # a block's matrix: from the label before it to its last label
    whole = np.broadcast_to(np.eye(labels), (len(owner), labels, labels)).copy()
    for t, m in enumerate(active):
        step = (whole[:m] @ trans) * emit[begin[:m] + t][:, None, :]
        whole[:m] = step / step.sum((1, 2), keepdims=True)
    first_block = rank == 0
    message_in = np.ones((len(owner), labels))  # the distribution before a block's transition
    message_out = np.ones((len(owner), labels))  # the backward message at a block's last word
    order, last = inverse, np.cumsum(counts) - 1
    state = np.zeros((len(lengths), labels))
    for k in range(int(counts.max())):
        has = np.flatnonzero(counts > k)
        at = order[last[has] - counts[has] + 1 + k]
        if k == 0:  # no label comes before the first word, so the block's matrix doesn't apply
            alpha = start * emit[begin[at]]
            alpha /= alpha.sum(1, keepdims=True)
            sizes = size[at]
            for t in range(1, int(sizes.max())):
                more = np.flatnonzero(sizes > t)
                step = (alpha[more] @ trans) * emit[begin[at[more]] + t]
                alpha[more] = step / step.sum(1, keepdims=True)
            state[has] = alpha
        else:
            message_in[at] = state[has]
            step = np.einsum("nl,nlm->nm", message_in[at], whole[at])
            state[has] = step / step.sum(1, keepdims=True)
    back = np.ones((len(lengths), labels))
    for k in range(int(counts.max()) - 1, -1, -1):
        has = np.flatnonzero(counts > k)
        at = order[last[has] - counts[has] + 1 + k]
        message_out[at] = back[has]
        step = np.einsum("nlm,nm->nl", whole[at], back[has])
        back[has] = step / step.sum(1, keepdims=True)

    alphas = np.empty_like(emit)
    alpha = message_in.copy()
    for t, m in enumerate(active):
        before = alpha[:m] @ trans
        if t == 0:
            before[first_block] = start
        step = before * emit[begin[:m] + t]
        alpha[:m] = step / step.sum(1, keepdims=True)
        alphas[begin[:m] + t] = alpha[:m]
    beta = message_out.copy()
    out = np.empty_like(emit)
    for t in range(len(active) - 1, -1, -1):
        m = active[t]
        at = begin[:m] + t
        product = alphas[at] * beta[:m]
        out[at] = product / product.sum(1, keepdims=True)
        step = (beta[:m] * emit[at]) @ trans.T
        beta[:m] = step / step.sum(1, keepdims=True)
    return out


def fit(texts: list[bytes], langs: list[str], steps: int = 300, batch: int = 64, length: int = 40, rate: float = 0.1, switch: float = 0.3, decay: float = 1e-4, seed: int = 3) -> Crf | None:
    """A conditional random field trained by Adam on the log-likelihood of label sequences.

    A document's words all have its language. So that transitions are learned from switches
    too, a training sequence joins runs of words of other documents with chance ``switch``.
    """
    names = sorted(set(langs))
    if not names:
        return None
    pool = []
    for text, lang in zip(texts, langs, strict=True):
        row, bucket, word = word_features(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        if len(row):
            order = np.argsort(word, kind="stable")
            pool.append((names.index(lang), bucket[order], np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(row)))])))
    size = len(names)
    used = np.unique(np.concatenate([b for _, b, _ in pool])) if pool else np.zeros(0, np.int64)
    place = np.zeros(1 << BUCKETS_LOG2, np.int32)
    place[used] = np.arange(1, len(used) + 1)
    pool = [(label, place[b], ends) for label, b, ends in pool]
    by_label = [[k for k, p in enumerate(pool) if p[0] == label] for label in range(size)]
    by_label = [ks for ks in by_label if ks]
    crf = Crf(names, np.zeros((len(used) + 1, size)), np.zeros((size, size)), np.zeros(size), place)
    if not pool or size == 1:
        return crf
    rng = np.random.default_rng(seed)
    moments = {k: [np.zeros_like(getattr(crf, k)), np.zeros_like(getattr(crf, k))] for k in ("transition", "first")}
    square = np.zeros_like(crf.emission)
    for step in range(1, steps + 1):
        bucket, word, gold, n = [], [], [], 0
        for _ in range(batch):
            left = length
            while left:
                take = left if rng.random() >= switch else int(rng.integers(1, left + 1))
                ks = by_label[rng.integers(len(by_label))]
                label, buckets, ends = pool[ks[rng.integers(len(ks))]]
                take = min(take, len(ends) - 1)
                at = int(rng.integers(0, len(ends) - take))
                bucket.append(buckets[ends[at] : ends[at + take]])
                word.append(np.repeat(np.arange(n, n + take), np.diff(ends[at : at + take + 1])))
                gold += [label] * take
                n += take
                left -= take
        bucket, word, gold = np.concatenate(bucket), np.concatenate(word), np.array(gold)
        scores = np.stack([np.bincount(word, crf.emission[bucket, k], n) for k in range(size)], 1)
        post, pair = _pair_marginals(scores.reshape(batch, length, size), crf.transition, crf.first)
        error = post.reshape(n, size)
        truth = gold.reshape(batch, length)
        grad_first = (post[:, 0].sum(0) - np.bincount(truth[:, 0], minlength=size)) / batch
        seen = np.zeros((size, size))
        np.add.at(seen, (truth[:, :-1].ravel(), truth[:, 1:].ravel()), 1)
        grad_transition = (pair - seen) / batch
        error = error.copy()
        error[np.arange(n), gold] -= 1
        used, at = np.unique(bucket, return_inverse=True)
        grad = np.stack([np.bincount(at, error[word, k], len(used)) for k in range(size)], 1) / batch + decay * crf.emission[used]
        square[used] += grad * grad  # Adagrad on the sparse part
        crf.emission[used] -= rate * grad / (np.sqrt(square[used]) + 1e-8)
        for k, g in (("transition", grad_transition), ("first", grad_first)):
            m, v = moments[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            getattr(crf, k)[...] -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return crf


def _pair_marginals(scores: np.ndarray, transition: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word marginals of equally long sequences, and expected counts of label pairs."""
    emit = np.exp(scores - scores.max(2, keepdims=True))
    trans = np.exp(transition)
    count, length, size = emit.shape
    alpha, beta = np.empty_like(emit), np.ones_like(emit)
    for t in range(length):
        a = (np.exp(first) if t == 0 else alpha[:, t - 1] @ trans) * emit[:, t]
        alpha[:, t] = a / a.sum(1, keepdims=True)
    for t in range(length - 2, -1, -1):
        b = (beta[:, t + 1] * emit[:, t + 1]) @ trans.T
        beta[:, t] = b / b.sum(1, keepdims=True)
    post = alpha * beta
    post /= post.sum(2, keepdims=True)
    pairs = alpha[:, :-1, :, None] * trans * (beta * emit)[:, 1:, None, :]
    return post, (pairs / pairs.sum((2, 3), keepdims=True)).sum((0, 1))


def train(docs: DataFrame, sample: int = SAMPLE_ROWS, least: int = LEAST_ROWS) -> Crf | None:
    """A model from a bounded sample of the training fold's rows with text and lang; None without any.

    Every language of the fold is learned: the sample holds the rows with the smallest id hashes
    of each, ``sample`` divided by the number of languages but at least ``least`` (and at least
    1), rows of at most ``SAMPLE_CHARS`` characters first. Of longer ones, which are only
    taken where a language lacks short ones, that many characters are learned from. The ranks
    within a language are limited in each task before they are shuffled.
    """
    known = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & train_fold(F.col("doc_id")))
    rows = durable(known.select("doc_id", "lang", (F.char_length("text") > SAMPLE_CHARS).alias("_long"), F.xxhash64("doc_id", "text").alias("_text")))
    languages = rows.select("lang").distinct().count()
    if not languages:
        return None
    each = max(1, least, sample // languages)
    by_hash = Window.partitionBy("lang").orderBy("_long", F.xxhash64("doc_id"), "doc_id", "_text")
    ids = durable(rows.withColumn("_rank", F.row_number().over(by_hash)).where(F.col("_rank") <= each).select("doc_id", "lang", "_text").distinct())
    text = known.select("doc_id", "lang", F.xxhash64("doc_id", "text").alias("_text"), F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    same = [F.col("t.lang") == F.col("i.lang"), F.col("t.doc_id").eqNullSafe(F.col("i.doc_id")), F.col("t._text") == F.col("i._text")]
    picked = sized_join(text.alias("t"), ids.alias("i"), same, "left_semi")
    found = [(r.text.encode(), r.lang) for r in picked.dropDuplicates().orderBy("lang", F.xxhash64("doc_id"), "doc_id", "text").toLocalIterator()]
    return fit([t for t, _ in found], [x for _, x in found])


def _has_letter(text) -> bool:
    return text is not None and any(map(str.isalpha, text))


def predict(batches, crf: Crf | None):
    """Batches without their text column, with lang_pred and score."""

    def out(parts, scores, lengths):
        names = np.array([*(crf.languages if crf else []), UNDETERMINED], object)
        und = len(names) - 1
        lengths = np.concatenate(lengths)
        sums = np.zeros((len(lengths), max(und, 1)))
        if crf and lengths.sum():
            post = marginals(np.concatenate(scores), lengths, crf.transition, crf.first)
            owner = np.repeat(np.arange(len(lengths)), lengths)
            sums = np.stack([np.bincount(owner, post[:, k], len(lengths)) for k in range(und)], 1)
        at = 0
        for part in parts:
            n = part.num_rows
            share = sums[at : at + n] / np.maximum(lengths[at : at + n], 1)[:, None]
            best = share.argmax(1)
            score = share[np.arange(n), best]
            texts = part.column("text")
            for i in range(n):
                if crf is None or not _has_letter(texts[i].as_py()):
                    best[i], score[i] = und, 0.0
            at += n
            rest = [k for k in part.schema.names if k != "text"]
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in rest), pa.array(names[best].tolist(), pa.string()), pa.array(np.clip(score, 0, 1))], [*rest, "lang_pred", "score"])

    parts, scores, lengths, held = [], [], [], 0
    for part in text_slices(batches):
        row, bucket, word = word_features(*flat_bytes(part))
        parts.append(part)
        lengths.append(np.bincount(row, minlength=part.num_rows))
        scores.append(crf.word_scores(len(row), bucket, word).astype(np.float32) if crf else np.zeros((0, 1)))
        held += len(row)
        if held * max(4, len(crf.languages) if crf else 0) >= 4 * GROUP_WORDS:
            yield from out(parts, scores, lengths)
            parts, scores, lengths, held = [], [], [], 0
    if parts:
        yield from out(parts, scores, lengths)


def language_id(docs: DataFrame, crf: Crf | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.

    All words of the whole text are labelled; the language with the largest mean posterior is
    the text's, and that mean its score. Texts that are null or without a letter are ``und``
    with score 0, as all are if nothing could be learned. Ties go to the first language by
    name. Repeated rows are labelled each; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda batches: predict(batches, crf), "doc_id long, held_out boolean, lang_pred string, score double")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return language_id(docs, train(docs))
