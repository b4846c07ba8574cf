"""Language identification by a linear-chain conditional random field over words.

Every word of a text gets a label; a word's features are its affixes, its
character n-grams and its entry in a lexicon, and learned transitions tie
neighbours together. Forward-backward gives each word's label marginals, so
code-switched text is labelled word by word; a document's language is the
label with the largest sum of marginals, and that label's share is its score.

Training: the lexicon counts words by language over all training documents
(a grouped count; each label's words above a count threshold go into the
model, chosen so that they are at most its share of ``lexicon_words``). The field itself is fitted by
Adam on a bounded sample: ``docs_per_label`` documents per label by a hash
of their text, ``SEGMENTS`` segments of ``SEGMENT_WORDS`` words each, from
all over the text; segments of different languages are put together, so the
transitions see switches. lang, source and doc_id never enter a prediction.

Prediction is a scan without a shuffle: the model is broadcast (its size is
fixed by the parameters), texts are read whole.

Cases: null texts and texts without a letter are ``und`` with score 0; so is
everything if there is no labelled training text; rows with a null lang
are predicted, but not learned from; repeated rows are predicted alike;
every label is learned, however rare; columns
besides the named ones are never looked at.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunked, python_step, read, staged

#: Runs of word characters without decimal digits; numerals among them (fractions, superscripts) are taken out after.
WORD = re.compile(r"[^\W\d_]+")
HASH_SIZE = 1 << 16
LEXICON_WORDS = 50_000
DOCS_PER_LABEL = 400
SEGMENTS, SEGMENT_WORDS = 4, 32
#: Longer words (run-together junk) are left out of the training sample.
MAX_SAMPLE_WORD = 64
EPOCHS, BATCH, RATE, DECAY = 5, 64, 0.05, 1e-4
#: Words whose scores a worker keeps, and scores in all.
CACHE_WORDS, CACHE_SCORES = 300_000, 1 << 24


def letter_runs(text: str | None) -> list:
    """The words of a text: its runs of letters."""
    found = WORD.findall(text) if text else []
    if found and not "".join(found).isalpha():
        found = [x for w in found for x in "".join(c if c.isalpha() else " " for c in w).split(" ") if x]
    return found


def words_of(text: str | None) -> list:
    """The words in lower case, one by one, so that each is still one word."""
    low = (text or "").lower()
    found = WORD.findall(low)
    if low.isascii() or len(low) == len(text) and "".join(found).isalpha():
        return found  # lowering has kept every character in its place
    found = letter_runs(text)
    return " ".join(found).lower().split(" ") if found else []


def held_out():
    """Remainder 2 of crc32 of the doc_id's text by 4; a null doc_id counts as an empty one."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(29))) & np.uint64(HASH_SIZE - 1)).astype(np.int64)


def features(words: list, lexicon: dict, labels: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of lower-case words, and the number of the word that has each."""
    marked = [f"^{w}$" for w in words]
    size = np.array([len(w) for w in marked])
    end = np.cumsum(size)
    begin = end - size
    chars = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    of = np.repeat(np.arange(len(words)), size)
    odd = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
    found, owner = [], []

    def add(at: np.ndarray, n: int, tag: int) -> None:
        with np.errstate(over="ignore"):
            h = np.full(len(at), tag * 0x100000001B3, np.uint64)
            for k in range(n):
                h = (h ^ (chars[at + k] * odd[k])) * odd[3 - k]
            found.append(_mixed(h))
        owner.append(of[at])

    for n in (1, 2, 3):  # n-grams inside a word
        at = np.arange(max(0, len(chars) - n + 1))
        add(at[of[at] == of[at + n - 1]], n, n)
    for n in (2, 3, 4):  # affixes
        long = size >= n
        add(begin[long], n, 10 + n)
        add(end[long] - n, n, 20 + n)
    own, names = [], []
    for i, w in enumerate(words):
        entry = ["bias", "unknown"]
        counts = lexicon.get(w)
        if counts:
            total = sum(counts)
            entry = ["bias", f"n{min(12, total.bit_length())}", *(f"l{g}:{round(8 * c / total)}" for g, c in zip(labels, counts))]
        names += entry
        own += [i] * len(entry)
    made = {x: zlib.crc32(x.encode()) % HASH_SIZE for x in set(names)}
    found.append(np.array([made[x] for x in names], np.int64))
    owner.append(np.array(own, np.int64))
    return np.concatenate(found), np.concatenate(owner)


def summed(flat: np.ndarray, owner: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """Per word the sum of its features' weights."""
    return np.stack([np.bincount(owner, weights[flat, k], n) for k in range(weights.shape[1])], axis=1)


class Field:
    """The model: labels, lexicon, feature weights, transitions and first-word weights."""

    def __init__(self, labels: list, lexicon: dict):
        n = len(labels)
        self.labels, self.lexicon = labels, lexicon
        self.weights = np.zeros((HASH_SIZE, n), np.float32)
        self.transitions = np.zeros((n, n))
        self.first = np.zeros(n)

    def emissions(self, words: list) -> np.ndarray:
        return summed(*features(words, self.lexicon, self.labels), self.weights, len(words))

    def marginals(self, scores: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Label marginals of every word, and of every pair of neighbours summed per sequence end.

        ``scores`` holds the words of all sequences one after the other;
        they are worked through step by step, all sequences at once.
        """
        order = np.argsort(-lengths, kind="stable")
        size = lengths[order]
        begin = np.concatenate(([0], np.cumsum(lengths)[:-1]))[order]
        steps = int(size[0]) if len(size) else 0
        active = np.searchsorted(-size, -np.arange(steps), side="left")  # sequences longer than t
        e = np.exp(scores - scores.max(axis=1, keepdims=True))
        a = np.exp(self.transitions - self.transitions.max())
        alpha, scale = np.empty_like(e), np.empty(len(e))
        now = np.exp(self.first - self.first.max()) + np.zeros((len(size), 1))
        for t in range(steps):
            n = active[t]
            at = begin[:n] + t
            now = (now[:n] if t == 0 else now[:n] @ a) * e[at]
            total = now.sum(axis=1, keepdims=True)
            now /= total
            alpha[at], scale[at] = now, total[:, 0]
        out, pairs = np.empty_like(e), np.zeros_like(a)
        after = np.ones((len(size), e.shape[1]))
        for t in range(steps - 1, -1, -1):
            n = active[t]
            at = begin[:n] + t
            out[at] = alpha[at] * after[:n]
            if t:
                ahead = after[:n] * e[at] / scale[at][:, None]
                pairs += a * (alpha[at - 1].T @ ahead)
                after[:n] = ahead @ a.T
        return out, pairs

    def fit(self, sequences: list[list[tuple[str, int]]], seed: int = 7) -> None:
        """Maximum likelihood by Adam over batches of labelled word sequences."""
        rng = np.random.default_rng(seed)
        number: dict = {}
        for s in sequences:
            for w, _ in s:
                number.setdefault(w, len(number))
        flat, owner = features(list(number), self.lexicon, self.labels)
        flat = flat[np.argsort(owner, kind="stable")]  # by word
        many = np.bincount(owner, minlength=len(number))
        first = np.cumsum(many) - many
        params = [self.weights.astype(np.float64), self.transitions, self.first]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        for _ in range(EPOCHS):
            for part in np.array_split(rng.permutation(len(sequences)), max(1, math.ceil(len(sequences) / BATCH))):
                chosen = [sequences[i] for i in part]
                lengths = np.array([len(s) for s in chosen])
                ids = np.array([number[w] for s in chosen for w, _ in s])
                gold = np.array([y for s in chosen for _, y in s])
                word, ids = np.unique(ids, return_inverse=True)
                part_of = np.repeat(np.arange(len(word)), many[word])
                at = np.arange(len(part_of)) - np.repeat(np.cumsum(many[word]) - many[word], many[word])
                part_flat = flat[np.repeat(first[word], many[word]) + at]
                scores = summed(part_flat, part_of, params[0], len(word))[ids]
                self.transitions, self.first = params[1], params[2]
                marginal, pairs = self.marginals(scores, lengths)
                marginal[np.arange(len(gold)), gold] -= 1.0
                begin = np.concatenate(([0], np.cumsum(lengths)[:-1]))
                inner = np.ones(len(gold), bool)
                inner[begin] = False
                at = np.flatnonzero(inner)
                np.add.at(pairs, (gold[at - 1], gold[at]), -1.0)
                by_word = [np.bincount(ids, marginal[:, k], len(word)) for k in range(marginal.shape[1])]
                grad = np.stack([np.bincount(part_flat, g[part_of], HASH_SIZE) for g in by_word], axis=1)
                step += 1
                for i, g in enumerate((grad, pairs, marginal[begin].sum(axis=0))):
                    g = g / len(gold) + DECAY * params[i]
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    params[i] = params[i] - RATE * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.999 ** step)) + 1e-8)
        self.weights, self.transitions, self.first = params[0].astype(np.float32), params[1], params[2]


def _train_rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", "lang").where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()) \
        .select("text", F.col("lang").cast("string").alias("lang"))


def lexicon_of(train: DataFrame, labels: list, words: int = LEXICON_WORDS) -> dict:
    """word -> counts by label, over all training documents: the most frequent words of each label, ``words`` in all at most."""

    def counts(batches: Iterator):
        import pyarrow as pa
        index = {x: i for i, x in enumerate(labels)}
        for b in batches:
            texts, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
            found = [Counter() for _ in labels]
            for t, g in zip(texts, langs):
                if g in index:
                    found[index[g]].update(words_of(t))
            for i, c in enumerate(found):
                yield pa.record_batch([pa.array(list(c), pa.string()), pa.array([i] * len(c), pa.int32()),
                                       pa.array(list(c.values()), pa.int64())], names=["word", "label", "n"])

    per = python_step(train, counts, "word string, label int, n long").groupBy("word").agg(
        F.sum("n").alias("total"), *[F.coalesce(F.sum(F.when(F.col("label") == i, F.col("n"))), F.lit(0)).alias(f"c{i}")
                                     for i in range(len(labels))])
    per = staged(per.where("total > 1"), "lang-words")
    # an equal share for each label: of its words, those above a threshold on a log scale that leaves at most so many
    share = max(1, words // max(1, len(labels)))
    level = F.floor(F.log2("n") * 16)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("label"), F.col(f"c{i}").alias("n")) for i in range(len(labels))]))
    hist = per.select(each.alias("x")).select("x.*").where("n > 0").groupBy("label", level.alias("level")).agg(F.count("*").alias("n"))
    kept, least = [0] * len(labels), [None] * len(labels)
    full = [False] * len(labels)
    for r in hist.orderBy("label", F.col("level").desc()).collect():  # labels x some hundred levels
        i = r["label"]
        full[i] = full[i] or kept[i] + r["n"] > share
        if not full[i]:
            kept[i], least[i] = kept[i] + r["n"], r["level"]
    rows = []
    for i in range(len(labels)):
        if least[i] is not None:
            rows += per.where((F.col(f"c{i}") > 0) & (F.floor(F.log2(F.greatest(F.lit(1), F.col(f"c{i}"))) * 16) >= least[i])).collect()
        elif full[i]:  # its most frequent words are more than its share and alike in number
            rows += per.where(f"c{i} > 0").orderBy(F.desc(f"c{i}"), "word").limit(share).collect()
    return {r["word"]: [r[f"c{i}"] for i in range(len(labels))] for r in rows if len(r["word"]) <= MAX_SAMPLE_WORD}


def sample(train: DataFrame, sizes: dict, docs_per_label: int = DOCS_PER_LABEL) -> list:
    """(lang, segments of words): about ``docs_per_label`` documents of each label, ``2 * docs_per_label`` at most."""
    share = F.create_map(*[F.lit(x) for g, n in sizes.items() for x in (g, min(1.0, 1.5 * docs_per_label / n))])
    ticket = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / (1 << 30)
    rows = train.where(F.col("lang").isin(list(sizes))).withColumn("ticket", ticket).where(F.col("ticket") < share[F.col("lang")])

    def cut(batches: Iterator):
        import pyarrow as pa
        for b in batches:
            out = []
            for t, g, x in zip(*(c.to_pylist() for c in b.columns)):
                words = [w for w in words_of(t) if len(w) <= MAX_SAMPLE_WORD]
                if words:
                    n = min(SEGMENTS, max(1, len(words) // SEGMENT_WORDS))
                    room = max(0, len(words) - SEGMENT_WORDS)
                    at = [room * i // max(1, n - 1) if n > 1 else 0 for i in range(n)]
                    out.append((g, x, [" ".join(words[i:i + SEGMENT_WORDS]) for i in at]))
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.record_batch([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()),
                                   pa.array(cols[2], pa.list_(pa.string()))], names=["lang", "ticket", "segments"])

    # as many copies of a text as there may be share one ticket, and count once
    cuts = python_step(rows.select("text", "lang", "ticket"), cut, "lang string, ticket double, segments array<string>").distinct()
    found: dict = {}
    for r in cuts.orderBy("ticket", "lang", "segments").limit(2 * docs_per_label * len(sizes)).collect():
        found.setdefault(r["lang"], []).append(r["segments"])
    return [(g, s) for g, many in sorted(found.items()) for s in many[:2 * docs_per_label]]


def sequences(sampled: list, labels: list, seed: int = 11) -> list:
    """Training sequences: half of them one segment, half two segments of any languages put together."""
    rng = np.random.default_rng(seed)
    parts = [[(w, labels.index(g)) for w in s.split(" ")] for g, many in sampled for s in many]
    parts = [parts[i] for i in rng.permutation(len(parts))]
    half = len(parts) // 2
    return parts[:half] + [a + b for a, b in zip(parts[half::2], parts[half + 1::2])]


def train(docs: DataFrame, docs_per_label: int = DOCS_PER_LABEL, lexicon_words: int = LEXICON_WORDS) -> Field:
    """Fit a field for every label of the training rows."""
    rows = _train_rows(docs)
    top = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row a language
    sizes = {r["lang"]: r["n"] for r in top}
    labels = sorted(sizes)
    field = Field(labels, lexicon_of(rows, labels, lexicon_words) if labels else {})
    if labels:
        field.fit(sequences(sample(rows, sizes, docs_per_label), labels))
    return field


class Tagger:
    """A field with a cache of word scores."""

    def __init__(self, field: Field):
        self.field = field
        self.index: dict = {}
        self.most = min(CACHE_WORDS, CACHE_SCORES // max(1, len(field.labels)))
        self.scores = np.empty((self.most + 1, len(field.labels)), np.float32)

    def ids(self, words: list) -> list:
        index = self.index
        new = list({w for w in words if w not in index})
        for i in range(0, len(new), 50_000):
            part = new[i:i + 50_000]
            at = len(index)
            index.update(zip(part, range(at, at + len(part))))
            while len(index) > len(self.scores):
                self.scores = np.concatenate((self.scores, np.empty_like(self.scores)))
            self.scores[at:at + len(part)] = self.field.emissions(part)
        return [index[w] for w in words]

    def words(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of all words of the texts (str or None), and the texts' numbers of words."""
        if len(self.index) > self.most:
            self.index, self.scores = {}, np.empty((self.most + 1, len(self.field.labels)), np.float32)
        lengths, words = [], []
        for t in texts:
            found = words_of(t)
            lengths.append(len(found))
            words += found
        ids = self.ids(words)
        lengths = np.array(lengths, np.int64)
        some = lengths > 0
        if not ids:
            return np.empty((0, len(self.field.labels))), lengths
        return self.field.marginals(self.scores[ids].astype(np.float64), lengths[some])[0], lengths

    def documents(self, texts: list) -> Iterator[tuple]:
        """(language, share) of each text."""
        marginal, lengths = self.words(texts)
        end = np.cumsum(lengths)
        total = np.concatenate((np.zeros((1, marginal.shape[1])), np.cumsum(marginal, axis=0)))
        for n, e in zip(lengths.tolist(), end.tolist()):
            if not n:
                yield "und", 0.0
                continue
            share = np.round((total[e] - total[e - n]) / n, 9)
            best = int(np.argmax(share))
            yield self.field.labels[best], float(min(1.0, max(0.0, share[best])))


_TAGGERS: dict = {}


def _tagger(shared) -> Tagger:
    key = getattr(shared, "_path", None) or id(shared)
    if key not in _TAGGERS:
        _TAGGERS.clear()
        _TAGGERS[key] = Tagger(shared.value)
    return _TAGGERS[key]


def predict(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    if not field.labels:
        return docs.select("doc_id", held_out().alias("held_out"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(field)
    limit = (16 << 20) // max(4, len(field.labels))

    def rows(batches: Iterator):
        import pyarrow as pa
        tagger = _tagger(shared)
        for b in batches:
            texts, out = b.column(2).to_pylist(), []
            for i, j in chunked(texts, limit):
                out += tagger.documents(texts[i:j])
            yield pa.record_batch([b.column(0), b.column(1), pa.array([x[0] for x in out], pa.string()),
                                   pa.array([x[1] for x in out], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return python_step(docs.select("doc_id", held_out().alias("held_out"), "text"), rows,
                       "doc_id long, held_out boolean, lang_pred string, score double")


def label_words(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id and, for each word in order, the word and its most probable label."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def rows(batches: Iterator):
        import pyarrow as pa
        tagger = _tagger(shared)
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                best = tagger.words([t])[0].argmax(axis=1) if field.labels else []
                words = letter_runs(t)  # one for one those of words_of
                yield pa.record_batch([pa.array([i], pa.int64()), pa.array([words[:len(best)]], pa.list_(pa.string())),
                                       pa.array([[field.labels[k] for k in best]], pa.list_(pa.string()))], names=["doc_id", "words", "labels"])

    return python_step(docs.select("doc_id", "text"), rows, "doc_id long, words array<string>, labels array<string>")


def op4_langid(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return predict(docs, train(docs))
