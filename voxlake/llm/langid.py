"""Language labels for words and documents: a linear-chain conditional random field.

A word's features are its character three- and four-grams, those at its edges (its affixes) marked as such,
and its entry in a lexicon of frequent words; their weights add up to one score per language. Transition
weights between the languages of adjacent words are learned with them. Training maximises the likelihood of
label sequences made from whole labelled documents, cut into spans of words and dealt together so that
languages alternate as they do in code-switched text. Labelling runs forward-backward over every word of
every text; a document's language is the one with the largest sum of word posteriors and its score that
language's share.

The recursions run over all words of a batch at once: words are cut into segments, the segments' transfer
matrices are multiplied up in parallel, messages are passed from segment to segment, and each segment is
then filled in. Document starts are reset matrices, so a text's length does not matter.

Grams are of UTF-8 bytes; every byte above 127 counts as a letter.

Defined cases: a text that is null or has no letter gets `und` and score 0; without labelled rows every text
does; rows without doc_id are never learned from; repeated rows get equal results; a very long text is one sequence and
is labelled whole; other columns are kept by identify and ignored by the query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import extended, load, tidy, unused
from .shingles import _BYTE, mix

UNKNOWN = "und"
#: Bounds of the training sample: documents of a language, characters of a document, languages.
DOCS_PER_LANGUAGE, SAMPLE_CHARS, MAX_LANGUAGES = 300, 20_000, 64
#: Spans of words of a training step, fewer for many languages, as a step holds a matrix of languages a word.
STEP_SPANS, FEWEST_SPANS = 600, 40
#: Rows of the feature table, words of the lexicon, passes over the sample.
TABLE_BITS, LEXICON, EPOCHS = 16, 4000, 4
TABLE = 1 << TABLE_BITS
SEGMENT = 128
SLICE_BYTES = 1 << 20

_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[97:123] = True
_IS_LETTER[128:] = True


class Words:
    """Words of a slice of texts: feature rows and word boundaries on the joined buffer."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n\n\n", np.uint8)
        letter = _IS_LETTER[raw]
        flat = np.where(letter, raw, 0).astype(np.uint64)
        start = letter.copy()
        start[1:] &= ~letter[:-1]
        at = np.flatnonzero(letter)
        starts = np.flatnonzero(start)
        self.n = len(starts)
        self.first = np.searchsorted(at, starts)  # of each word among the letters
        three = flat[at - 1] << np.uint64(16) | flat[at] << np.uint64(8) | flat[at + 1]
        four = three << np.uint64(8) | flat[at + 2] | np.uint64(1 << 40)
        # TABLE rows; a gram that leaves the word ends at its edge
        four = np.where(flat[at + 1] == 0, three | np.uint64(1 << 41), four)
        self.grams = [(g * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - TABLE_BITS)).astype(np.int64) for g in (three, four)]
        step = np.arange(len(at)) - np.repeat(self.first, np.diff([*self.first, len(at)])) if self.n else np.zeros(0, np.int64)
        spread = _BYTE[raw[at]] * mix(step.astype(np.uint64) + np.uint64(7))
        self.hash = mix(np.add.reduceat(spread, self.first)) if self.n else np.zeros(0, np.uint64)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        ends = np.cumsum(sizes) + 1
        self.doc_edges = np.concatenate([[0], np.searchsorted(starts, ends)])  # words before each text
        begin = np.repeat(ends - sizes, np.diff(self.doc_edges))
        self.starts, self.ends = starts - begin, starts - begin + np.diff([*self.first, len(at)])  # bytes of each word's text
        self.is_first = np.zeros(self.n, bool)
        heads = self.doc_edges[:-1]
        self.is_first[heads[heads < self.n]] = True


class Model:
    def __init__(self, langs: list[str], lexicon: np.ndarray):
        n = len(langs)
        self.langs, self.lexicon = langs, lexicon
        self.table = np.zeros((TABLE, n), np.float32)
        self.lex = np.zeros((len(lexicon) + 1, n), np.float32)
        self.step = np.zeros((n, n))

    def entries(self, w: Words) -> np.ndarray:
        if not len(self.lexicon):
            return np.zeros(w.n, np.int64)
        k = np.minimum(np.searchsorted(self.lexicon, w.hash), len(self.lexicon) - 1)
        return np.where(self.lexicon[k] == w.hash, k, len(self.lexicon))

    def emissions(self, w: Words) -> np.ndarray:
        e = np.add.reduceat(self.table[w.grams[0]] + self.table[w.grams[1]], w.first, axis=0)
        e += self.lex[self.entries(w)]
        e -= e.max(1, keepdims=True)
        return np.exp(np.maximum(e, -40).astype(np.float64))


def _norm(x: np.ndarray, axis) -> np.ndarray:
    return x / x.sum(axis=axis, keepdims=True)


def _sweep(e: np.ndarray, reset: np.ndarray, t: np.ndarray, backward: bool) -> np.ndarray:
    """Normalised messages of a recursion over all words. Forward: m' = (m t) e, at a reset e alone; the message
    holds the word's own emission. Backward: m' = t (e m), at a reset 1; e and reset are those of the word after."""
    n, k = e.shape
    seg = -(-n // SEGMENT)
    pad = seg * SEGMENT - n
    e = np.concatenate([e, np.ones((pad, k))]).reshape(seg, SEGMENT, k)
    reset = np.concatenate([reset, np.ones(pad, bool)]).reshape(seg, SEGMENT)
    if backward:
        t = t.T

    def advance(m, j):  # rows of m are messages
        rows = m.reshape(-1, k)
        if backward:
            out = ((rows.reshape(seg, -1, k) * e[:, j][:, None, :]).reshape(-1, k) @ t).reshape(m.shape)
        else:
            out = (rows @ t).reshape(seg, -1, k) * e[:, j][:, None, :]
        r = reset[:, j]
        if r.any():
            out = out.reshape(seg, -1, k)
            out[r] = np.ones((1, 1, k)) if backward else e[r, j][:, None, :]
        if j % 8 == 0 or len(m[0]) == 1:  # eight steps stay within the range of a double
            out /= out.sum(2, keepdims=True).max(1, keepdims=True)
        return out

    order = range(SEGMENT - 1, -1, -1) if backward else range(SEGMENT)
    m = np.broadcast_to(np.eye(k), (seg, k, k)).copy()
    for j in order:
        m = advance(m, j)
    inward = np.empty((seg, k))
    v = np.full(k, 1 / k)
    for s in range(seg - 1, -1, -1) if backward else range(seg):
        inward[s] = v
        v = v @ m[s]
        v = v / v.sum()
    out = np.empty((seg, SEGMENT, k))
    x = inward[:, None, :]
    for j in order:
        x = advance(x, j)
        out[:, j] = x[:, 0]
    return out.reshape(-1, k)[:n]


def forward_backward(e: np.ndarray, is_first: np.ndarray, step: np.ndarray):
    """Messages and posteriors of all words; is_first marks the first word of a sequence."""
    t = np.exp(step - step.max())
    alpha = _sweep(e, is_first, t, False)
    # beta of word i comes from word i + 1
    beta = np.ones_like(e)
    if len(e) > 1:
        beta[:-1] = _sweep(e[1:], is_first[1:], t, True)
    return alpha, beta, t, _norm(alpha * beta, 1)


def train(texts: list[str], labels: list[str], seed: int = 0) -> Model:
    """Learn from whole texts with a language each."""
    langs = sorted(set(labels))
    raw = [x.lower().encode() for x in texts]
    whole = Words(raw)
    values, counts = np.unique(whole.hash, return_counts=True)
    model = Model(langs, np.sort(values[np.argsort(-counts, kind="stable")[:LEXICON]]))
    k = len(langs)
    y_doc = np.array([langs.index(x) for x in labels])
    y = np.repeat(y_doc, np.diff(whole.doc_edges))
    # spans of 5 to 60 words of one document, dealt in random order
    rng = np.random.default_rng(seed)
    spans = []
    for a, b in zip(whole.doc_edges, whole.doc_edges[1:]):
        while a < b:
            c = min(b, a + int(rng.integers(5, 60)))
            spans.append((a, c))
            a = c
    if not spans:
        return model
    spans = np.array(spans)
    letters = np.concatenate([whole.first, [len(whole.grams[0])]])
    entry = model.entries(whole)
    g_table, g_lex, g_step = np.full((TABLE, k), 1e-3), np.full((len(model.lex), k), 1e-3), np.full((k, k), 1e-3)
    rate, step_spans = 0.25, max(FEWEST_SPANS, min(STEP_SPANS, STEP_SPANS * 64 // (k * k)))
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(len(spans)), max(1, len(spans) // step_spans)):
            words = np.concatenate([np.arange(a, b) for a, b in spans[part]])
            size = letters[words + 1] - letters[words]
            first = np.cumsum(size) - size
            at = np.repeat(letters[words] - first, size) + np.arange(size.sum())
            grams = [g[at] for g in whole.grams]
            e = np.add.reduceat(model.table[grams[0]] + model.table[grams[1]], first, axis=0) + model.lex[entry[words]]
            e = np.exp(np.maximum(e - e.max(1, keepdims=True), -40).astype(np.float64))
            is_first = np.zeros(len(words), bool)
            is_first[np.cumsum(spans[part][:, 1] - spans[part][:, 0])[7::8][:-1]] = True  # a sequence is 8 spans
            is_first[0] = True
            alpha, beta, t, post = forward_backward(e, is_first, model.step)
            miss = np.eye(k)[y[words]] - post
            on = np.flatnonzero(~is_first[1:]) + 1
            pair = alpha[on - 1][:, :, None] * t[None] * (e[on] * beta[on])[:, None, :]
            pair /= pair.sum((1, 2), keepdims=True)
            seen = np.zeros((k, k))
            np.add.at(seen, (y[words][on - 1], y[words][on]), 1)
            scale = 1 / len(words)
            by_letter = np.repeat(miss, size, axis=0)
            for j in range(k):
                g = sum(np.bincount(x, by_letter[:, j], TABLE) for x in grams) * scale - 1e-6 * model.table[:, j]
                g_table[:, j] += g * g
                model.table[:, j] += rate * g / np.sqrt(g_table[:, j])
                g = np.bincount(entry[words], miss[:, j], len(model.lex)) * scale
                g_lex[:, j] += g * g
                model.lex[:, j] += rate * g / np.sqrt(g_lex[:, j])
            model.lex[-1] = 0
            g = (seen - pair.sum(0)) * scale - 1e-4 * model.step
            g_step += g * g
            model.step += rate * g / np.sqrt(g_step)
    return model


def _slices(texts: pa.Array):
    """(first, end) of slices of SLICE_BYTES, or of one longer text."""
    total = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + SLICE_BYTES, side="right")))
        yield at, to
        at = to


def label_texts(model: Model, texts: pa.Array):
    """Language, score and mean confidence of the words, that of each in its own likeliest language, of each text;
    null for texts without a letter."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    has_letter = pc.match_substring_regex(texts, r"\p{L}").to_pylist()
    for at, to in _slices(texts):
        w = Words(pc.utf8_lower(texts.slice(at, to - at)).cast(pa.large_binary()).to_pylist())
        if w.n:
            post = forward_backward(model.emissions(w), w.is_first, model.step)[3]
            sums = np.concatenate([np.zeros((1, post.shape[1])), np.cumsum(post, 0)])
            share = sums[w.doc_edges[1:]] - sums[w.doc_edges[:-1]]
            sure = np.concatenate([[0.0], np.cumsum(post.max(1))])
            sure = sure[w.doc_edges[1:]] - sure[w.doc_edges[:-1]]
        else:
            share, sure = np.zeros((to - at, len(model.langs))), np.zeros(to - at)
        n = share.sum(1)
        for i in range(to - at):
            if has_letter[at + i] and n[i] > 0:
                j = int(share[i].argmax())
                yield model.langs[j], min(1.0, max(0.0, float(share[i, j] / n[i]))), min(1.0, max(0.0, float(sure[i] / n[i])))
            else:
                yield None


def _crc(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


def fit(docs: DataFrame, seed: int = 0) -> Model | None:
    """Learn from a bounded sample of labelled rows of docs(doc_id, text, lang) outside the held-out fold; the same
    number of documents of each language, by a hash of doc_id."""
    usable = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL").where(_crc(F.col("doc_id")) % 5 != 0).where(F.length("text") <= SAMPLE_CHARS)
    counts = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if not counts:
        return None
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    part = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 1.3 * DOCS_PER_LANGUAGE / n))])
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    picked = usable.withColumn("place", place).where(F.col("place") < part[F.col("lang")] * float(1 << 40)).collect()
    sample = []
    for lang in counts:
        sample += sorted((r for r in picked if r.lang == lang), key=lambda r: (r.place, r.text))[:DOCS_PER_LANGUAGE]
    return train([r.text for r in sample], [r.lang for r in sample], seed)


def identify(docs: DataFrame, model: Model | None, names: tuple[str, str, str] = ("lang_pred", "score", "confidence")) -> DataFrame:
    """docs(doc_id, text, ...) -> all columns, and language, score and confidence under names; columns of docs so named
    are replaced."""
    plain = docs.drop(*names)
    if model is None:
        return plain.withColumns(dict(zip(names, (F.lit(UNKNOWN), F.lit(0.0), F.lit(0.0)))))
    held = docs.sparkSession.sparkContext.broadcast(model)  # TABLE rows and LEXICON words at most

    def run(batches):
        for b in batches:
            k = b.schema.get_field_index("text")
            found = list(label_texts(held.value, b.column(k)))
            lang, score, sure = [x[0] if x else UNKNOWN for x in found], [x[1] if x else 0.0 for x in found], [x[2] if x else 0.0 for x in found]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(sure, pa.float64())], names=[*b.schema.names, *names])

    plain = plain.withColumn("text", F.col("text").cast("string"))
    return plain.mapInArrow(tidy(run), extended(plain.schema, f"`{names[0]}` string, `{names[1]}` double, `{names[2]}` double"))


def label_words(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text) -> a row per word: doc_id, start and end (bytes of the lower-cased text as UTF-8), lang_pred,
    confidence (its posterior). Words are runs of letters a to z and bytes above 127; texts without one give no rows."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            texts = pc.utf8_lower(pc.fill_null(b.column(1).cast(pa.large_string()), ""))
            for at, to in _slices(texts):
                w = Words(texts.slice(at, to - at).cast(pa.large_binary()).to_pylist())
                if not w.n:
                    continue
                post = forward_backward(held.value.emissions(w), w.is_first, held.value.step)[3]
                doc = np.repeat(np.arange(at, to), np.diff(w.doc_edges))
                best = post.argmax(1)
                for i in range(0, w.n, 50_000):
                    j = slice(i, i + 50_000)
                    lang = pa.DictionaryArray.from_arrays(pa.array(best[j].astype(np.int32)), pa.array(held.value.langs, pa.string())).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc[j])), pa.array(w.starts[j]), pa.array(w.ends[j]), lang, pa.array(post[j].max(1))], names=["doc_id", "start", "end", "lang_pred", "confidence"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(tidy(run), f"doc_id {kind}, start long, end long, lang_pred string, confidence double")


def keep_known(docs: DataFrame, least_confidence: float = 0.4) -> DataFrame:
    """docs without those whose words' languages can't be told; texts that mix languages stay, and all columns as they are."""
    names = unused(docs, "lang_pred", "score", "confidence")
    found = identify(docs, fit(docs), tuple(names))
    return found.where((F.col(names[0]) != UNKNOWN) & (F.col(names[2]) >= least_confidence)).drop(*names)


def op6_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", F.coalesce(_crc(F.col("doc_id")) % 5 == 0, F.lit(True)).alias("held_out"), "lang_pred", "score")
