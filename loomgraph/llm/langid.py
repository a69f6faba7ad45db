"""Language of documents and of their segments: averaged hashed subword embeddings with a linear softmax.

A segment (a sentence or a line) is the average of the embeddings of its hashed character 3- and 4-grams; a linear
softmax over the average gives the language. The model is trained here by stochastic gradient descent in numpy on a
bounded sample of labelled documents, twice: the second time without the segments that contradict the first model,
since labels may be wrong and texts mixed. A held-out part of the sample calibrates the confidence (temperature) and
the confidence below which a segment is rejected: it then takes a neighbour's language that fits it, or none.

For inference embeddings and softmax weights are one table (the average is linear), and whole batches of texts are
hashed, looked up and summed per segment as flat arrays; no text passes through a loop over characters.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: ISO 639 codes and names of languages, without accents. What is told apart are those that labels name.
SPELLINGS = {
    "en": "en eng english englisch anglais ingles engels",
    "de": "de deu ger german deutsch allemand aleman alemao duits",
    "fr": "fr fra fre french francais franzosisch frances frans",
    "es": "es spa spanish espanol castellano spanisch espagnol espanhol spaans",
    "pt": "pt por portuguese portugues portugiesisch portugais portugees",
    "nl": "nl nld dut dutch nederlands niederlandisch neerlandais neerlandes holandes",
}

#: Fewer words that begin with a letter (names, numbers, field names) are too little to tell a language by.
SPELT = 5
#: The language of what is rejected.
UNKNOWN = "und"


@dataclass(frozen=True)
class LangSpec:
    """``sample``: labelled documents to learn from, for each language at most (the only bound on training data); the
    languages told apart are those of the labels met in it.

    ``precision``: of the accepted held-out segments, so many must be right; ``strange``: share of the right ones that
    are left out of account where it is set how many n-grams must have been met in training. ``share``: part of a document's words that a language must cover to be one of its languages.
    """

    sample: int = 300
    buckets: int = 1 << 16
    dim: int = 16
    epochs: int = 3
    rate: float = 0.1
    batch: int = 64
    held_out: float = 0.2
    precision: float = 0.995
    strange: float = 0.002
    cleanings: int = 2
    share: float = 0.2
    seed: int = 5


def label_language(label: Column) -> Column:
    """The language that a label names in any common spelling (code, regional code, name), or null."""
    spelt = F.create_map(*[F.lit(x) for code, names in SPELLINGS.items() for name in names.split() for x in (name, code)])
    clean = F.translate(F.lower(F.trim(F.coalesce(label, F.lit("")))), "áàâãäéèêëíìîïóòôõöúùûüçñ", "aaaaaeeeeiiiiooooouuuucn")
    code = F.regexp_extract(clean, r"^([a-z]{2,3})[-_][a-z]{2,4}([-_][a-z0-9]+)*$", 1)
    return F.coalesce(F.try_element_at(spelt, clean), F.try_element_at(spelt, code))


def _letters() -> np.ndarray:
    """0 for what is no letter or digit, 1 for digits, 2 for letters, 3 for invisible format characters (they are part of
    the word that they stand in), by code point of the basic plane."""
    kinds = np.zeros(0x10000, np.uint8)
    for c in range(0x10000):
        ch = chr(c)
        if ch.isalpha():
            kinds[c] = 2
        elif ch.isalnum():
            kinds[c] = 1
        elif unicodedata.category(ch) == "Cf":
            kinds[c] = 3
    return kinds


_KIND: np.ndarray | None = None
_ENDS = np.array([ord(c) for c in ".!?…;"])
_QUOTES = np.array([ord(c) for c in "“”„«»\""])


def fold(text: str) -> str:
    """Lower case without accents: case and accents differ between spellings of a language, not between languages."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFKD", text.casefold())


@dataclass
class Batch:
    """Segments of many texts as flat arrays. Every text has at least one segment."""

    doc: np.ndarray  # text of each segment
    begin: np.ndarray  # first character in the text's own folded form
    length: np.ndarray
    words: np.ndarray  # words in each segment
    spelt: np.ndarray  # of these, words that begin with a letter
    features: np.ndarray  # hashed n-grams of all segments
    segment: np.ndarray  # segment of each feature


def analyse(texts: list[str | None], buckets: int) -> Batch:
    global _KIND
    if _KIND is None:
        _KIND = _letters()
    folded = [fold(t or "") for t in texts]
    lengths = np.array([len(t) + 1 for t in folded], np.int64)
    code = np.frombuffer("".join(t + "\n" for t in folded).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc_at = np.repeat(np.arange(len(folded)), lengths)
    small = np.minimum(code, 0xFFFF).astype(np.int64)
    combining = (code >= 0x300) & (code < 0x370)
    kind = np.where(combining, 3, _KIND[small])
    space = (code == 32) | (code == 10) | (code == 13) | (code == 9) | (code == 0xA0)
    after = np.r_[space[1:], True]
    ends = (np.isin(code, _ENDS) & after) | (code == 10) | np.isin(code, _QUOTES)
    last = np.cumsum(lengths) - 1
    ends[last] = True
    seg_at = np.r_[0, np.cumsum(ends)[:-1]]
    n_seg = int(seg_at[-1]) + 1 if len(seg_at) else 0
    # A word starts at a letter or digit after none (accents belong to the letter before them).
    alnum = kind > 0
    starts = alnum & ~np.r_[False, alnum[:-1]]
    words = np.bincount(seg_at[starts], minlength=n_seg)
    spelt = np.bincount(seg_at[starts & (kind == 2)], minlength=n_seg)
    first = np.flatnonzero(np.r_[True, seg_at[1:] != seg_at[:-1]]) if n_seg else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, len(code)])
    doc = doc_at[first]
    begin = first - (np.cumsum(lengths) - lengths)[doc]
    # Grams run over letters and single breaks; accents are taken out first.
    keep = kind != 3
    c, seg = np.where(kind[keep] == 2, small[keep], 0).astype(np.uint32), seg_at[keep]
    feats, segs = [], []
    for n in (3, 4):
        m = len(c) - n + 1
        if m <= 0:
            continue
        inside = c[1 : 1 + m] > 0
        for i in range(2, n - 1):
            inside &= c[i : i + m] > 0
        h = np.full(m, n, np.uint32)
        for i in range(n):
            h = (h ^ c[i : i + m]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        at = np.flatnonzero(inside & (seg[:m] == seg[n - 1 : n - 1 + m]))
        feats.append((h[at] & np.uint32(buckets - 1)).astype(np.int32))
        segs.append(seg[at])
    features = np.concatenate(feats) if feats else np.zeros(0, np.int32)
    return Batch(doc, begin, size, words, spelt, features, np.concatenate(segs) if segs else np.zeros(0, np.int64))


def group_scores(features: np.ndarray, group: np.ndarray, n: int, table: np.ndarray) -> np.ndarray:
    """(groups, languages): average of the table's rows over each group's features; zeros without features."""
    out = np.zeros((n, table.shape[1]), np.float64)
    count = np.bincount(group, minlength=n)
    for k in range(table.shape[1]):
        out[:, k] = np.bincount(group, weights=table[:, k][features], minlength=n)
    return out / np.maximum(count, 1)[:, None]


def segment_scores(batch: Batch, table: np.ndarray) -> np.ndarray:
    return group_scores(batch.features, batch.segment, len(batch.doc), table)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Model:
    names: tuple[str, ...]  # the languages
    table: np.ndarray  # (buckets, languages) float32
    temperature: float
    least: float  # confidence below which a segment is rejected
    seen: np.ndarray  # (buckets,) 1.0 for n-grams met in training
    familiar: float  # share of n-grams met in training below which a segment is rejected


def _sgd(feats: list[np.ndarray], y: np.ndarray, n: int, spec: LangSpec, level: bool) -> np.ndarray:
    """Trained table: embeddings times softmax weights. ``level``: languages weigh equally. Steps are scaled per row (AdaGrad)."""
    rng = np.random.default_rng(spec.seed)
    emb = rng.uniform(-1 / spec.dim, 1 / spec.dim, (spec.buckets, spec.dim)).astype(np.float32)
    w = rng.uniform(-0.1, 0.1, (spec.dim, n)).astype(np.float32)
    seen_e, seen_w = np.full(spec.buckets, 1e-8, np.float32), np.full(w.shape, 1e-8, np.float32)
    freq = np.bincount(y, minlength=n)
    weight = (len(y) / np.maximum(freq, 1) / max(1, np.count_nonzero(freq))).astype(np.float32) if level else np.ones(n, np.float32)
    for _ in range(spec.epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), spec.batch):
            pick = order[lo : lo + spec.batch]
            size = np.array([len(feats[i]) for i in pick])
            flat = np.concatenate([feats[i] for i in pick])
            start = np.r_[0, np.cumsum(size)[:-1]]
            mean = np.add.reduceat(emb[flat], start, axis=0) / size[:, None].astype(np.float32)
            p = softmax(mean @ w)
            p[np.arange(len(pick)), y[pick]] -= 1
            p *= (weight[y[pick]] / len(pick))[:, None]
            back = (p @ w.T / size[:, None]).astype(np.float32)
            grad = mean.T @ p
            seen_w += grad * grad
            w -= (spec.rate * grad / np.sqrt(seen_w)).astype(np.float32)
            by = np.argsort(flat, kind="stable")
            row = flat[by]
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            total = np.add.reduceat(np.repeat(back, size, axis=0)[by], first, axis=0)
            row = row[first]
            seen_e[row] += (total * total).mean(axis=1)
            emb[row] -= spec.rate * total / np.sqrt(seen_e[row])[:, None]
    return emb @ w


def train(texts: list[str], labels: list[str], spec: LangSpec = LangSpec()) -> Model:
    """A calibrated model from labelled texts; labels and texts may be partly wrong and mixed."""
    names = tuple(sorted(set(labels)))
    n = len(names)
    if not texts:
        return Model(names, np.zeros((spec.buckets, n), np.float32), 1.0, 1.0, np.zeros(spec.buckets), 0.0)
    batch = analyse(texts, spec.buckets)
    y = np.array([names.index(x) for x in labels])[batch.doc]
    order = np.argsort(batch.segment, kind="stable")
    flat = batch.features[order]
    count = np.bincount(batch.segment, minlength=len(y))
    feats = np.split(flat, np.cumsum(count)[:-1])
    good = np.flatnonzero((batch.spelt >= SPELT) & (count > 0))
    rng = np.random.default_rng(spec.seed)
    held = rng.random(len(texts))[batch.doc[good]] < spec.held_out
    fit, test = good[~held], good[held]
    if not len(fit) or not len(test):
        fit = test = good
    if not len(fit):
        return Model(names, np.zeros((spec.buckets, n), np.float32), 1.0, 1.0, np.zeros(spec.buckets), 0.0)
    # Wrong labels are a minority of all segments of a language, if not of those with a label: the first models see
    # the segments as they are, and only segments that they agree with are learned from by the last.
    kept = fit
    for cleaning in range(spec.cleanings):
        scores = segment_scores(batch, _sgd([feats[i] for i in kept], y[kept], n, spec, level=False).astype(np.float32))
        agrees = scores.argmax(axis=1) == y
        kept = fit[agrees[fit]] if agrees[fit].any() else fit
    table = _sgd([feats[i] for i in kept], y[kept], n, spec, level=True).astype(np.float32)
    seen = (np.bincount(np.concatenate([feats[i] for i in kept]), minlength=spec.buckets) >= 2).astype(np.float64)
    scores = segment_scores(batch, table)
    test = test[agrees[test]] if len(test) else kept
    if not len(test):
        return Model(names, table, 1.0, 0.5, seen, 0.0)
    # Confidence is relative among the languages known: what is none of them shows by its unknown n-grams.
    known = np.array([seen[feats[i]].mean() for i in test])
    # Half way from what random letters have to what all but ``strange`` of the held-out segments have.
    familiar = float(seen.mean() + np.quantile(known, spec.strange)) / 2
    truth = y[test]
    grid = 2.0 ** np.arange(-3, 4, 0.25)
    loss = [-np.log(softmax(scores[test] * t)[np.arange(len(test)), truth] + 1e-12).mean() for t in grid]
    t = float(grid[int(np.argmin(loss))])
    p = softmax(scores[test] * t)
    conf, right = p.max(axis=1), p.argmax(axis=1) == truth
    rank = np.argsort(-conf)
    ok = np.flatnonzero(np.cumsum(right[rank]) / np.arange(1, len(rank) + 1) >= spec.precision)
    least = float(conf[rank[ok[-1]]]) if len(ok) else 0.9
    return Model(names, table, t, float(np.clip(least, 0.4, 0.9)), seen, familiar)


def labelled_sample(docs: DataFrame, spec: LangSpec) -> list[tuple[str, str]]:
    """At most ``spec.sample`` (text, language) of each language, a fixed pseudorandom choice by id."""
    known = docs.select("doc_id", "text", label_language(F.col("lang")).alias("label")).where(F.col("label").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    # One scan: each task hands on no more than ``sample`` of each language, those of the lowest draws.
    order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id", F.lit(spec.seed)), "doc_id", "text")
    picked = known.withColumn("r", F.row_number().over(order)).where(F.col("r") <= spec.sample).select("text", "label")
    return sorted((r["text"], r["label"]) for r in picked.collect())


def decide(batch: Batch, model: Model, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(language, confidence) of each segment; language ``len(model.names)`` is that of what is rejected.

    Short segments in a row are judged as one. What is too short takes the language of the nearest accepted segment of
    its text before it, else after it. What is long enough but not sure takes it as well, if it is as likely as any by
    chance there. A text with nothing accepted is judged as a whole. All else is rejected, at its confidence in its best.
    """
    n, k = len(batch.doc), len(model.names)
    if not n or not k:
        return np.full(n, k), np.zeros(n)
    short = batch.spelt < SPELT
    new = np.r_[True, (batch.doc[1:] != batch.doc[:-1]) | ~short[1:] | ~short[:-1]]
    group = np.cumsum(new) - 1
    doc, n_groups = batch.doc[new], int(group[-1]) + 1
    spelt = np.bincount(group, weights=batch.spelt, minlength=n_groups)
    of = group[batch.segment]
    scores = group_scores(batch.features, of, n_groups, model.table) * model.temperature
    p = softmax(scores)
    best, conf = p.argmax(axis=1), p.max(axis=1)
    count = np.bincount(of, minlength=n_groups)
    met = np.bincount(of, weights=model.seen[batch.features], minlength=n_groups)
    strange = met < model.familiar * count
    sure = (conf >= model.least) & (spelt >= SPELT) & ~strange
    idx = np.arange(n_groups)
    before = np.maximum.accumulate(np.where(sure, idx, -1))
    after = np.minimum.accumulate(np.where(sure, idx, n_groups)[::-1])[::-1]
    has_before = (before >= 0) & (doc[np.maximum(before, 0)] == doc)
    has_after = (after < n_groups) & (doc[np.minimum(after, n_groups - 1)] == doc)
    mass = np.stack([np.bincount(doc, weights=scores[:, j] * count, minlength=n_docs) for j in range(k)], axis=1)
    whole = softmax(mass / np.maximum(np.bincount(doc, weights=count, minlength=n_docs), 1)[:, None])
    in_doc = [np.bincount(doc, weights=x, minlength=n_docs) for x in (met, count, spelt)]
    alien = (in_doc[0] < model.familiar * in_doc[1]) & (in_doc[2] >= SPELT)
    as_whole = np.where((whole.max(axis=1) >= model.least) & ~alien, whole.argmax(axis=1), k)[doc]
    near = np.where(has_before, best[np.maximum(before, 0)], np.where(has_after, best[np.minimum(after, n_groups - 1)], as_whole))
    fits = (near < k) & ((spelt < SPELT) | (~strange & (p[idx, np.minimum(near, k - 1)] >= 1 / k)))
    lang = np.where(sure, best, np.where(fits, near, k))
    alone = ~(has_before | has_after) & (lang < k)
    given = np.where(alone, whole[doc, np.minimum(lang, k - 1)], p[idx, np.minimum(lang, k - 1)])
    return lang[group], np.where(lang < k, given, conf)[group]


SEGMENT_SCHEMA = "doc_id long, segment_no int, begin int, length int, words int, lang string, confidence double"
DOCUMENT_SCHEMA = "doc_id long, label string, lang string, words long, share double, confidence double"


def _scan(docs: DataFrame, model: Model, spec: LangSpec, whole: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = np.array([*model.names, UNKNOWN], object)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for lo in range(0, rb.num_rows, 500):
                b = rb.slice(lo, 500)
                batch = analyse(b.column(1).to_pylist(), spec.buckets)
                lang, conf = decide(batch, shared.value, b.num_rows)
                if not whole:
                    some = np.flatnonzero(batch.words > 0)
                    doc = batch.doc[some]
                    number = np.arange(len(some)) - np.searchsorted(doc, doc)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(doc)), pa.array(number, pa.int32()), pa.array(batch.begin[some], pa.int32()), pa.array(batch.length[some], pa.int32()), pa.array(batch.words[some], pa.int32()), pa.array(names[lang[some]], pa.string()), pa.array(conf[some])],
                        names=["doc_id", "segment_no", "begin", "length", "words", "lang", "confidence"],
                    )
                    continue
                cell = batch.doc * len(names) + lang
                size = b.num_rows * len(names)
                words = np.bincount(cell, weights=batch.words, minlength=size)
                mass = np.bincount(cell, weights=batch.words * conf, minlength=size)
                total = np.bincount(batch.doc, weights=batch.words, minlength=b.num_rows)
                at = np.flatnonzero(words)
                doc = at // len(names)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(doc)), b.column(2).take(pa.array(doc)), pa.array(names[at % len(names)], pa.string()), pa.array(words[at].astype(np.int64)), pa.array(words[at] / total[doc]), pa.array(mass[at] / words[at])],
                    names=["doc_id", "label", "lang", "words", "share", "confidence"],
                )

    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), F.col("text").cast("string"), label_language(F.col("lang")).alias("label"))
    return rows.mapInArrow(run, DOCUMENT_SCHEMA if whole else SEGMENT_SCHEMA)


def fit(docs: DataFrame, spec: LangSpec = LangSpec()) -> Model:
    sample = labelled_sample(docs, spec)
    return train([t for t, _ in sample], [x for _, x in sample], spec)


def segments(docs: DataFrame, spec: LangSpec = LangSpec(), model: Model | None = None) -> DataFrame:
    """One row per segment with words: place in the folded text, language and confidence. Null texts give no rows."""
    return _scan(docs, model or fit(docs, spec), spec, whole=False)


def document_languages(docs: DataFrame, spec: LangSpec = LangSpec(), model: Model | None = None) -> DataFrame:
    """(doc_id, label, lang, words, share, confidence): each language of each document with the share of its words.

    ``label`` is the language that the document's own label names, or null; ``lang`` is ``und`` for what is rejected.
    Texts without words and null texts give no rows. With no labelled documents at all everything is rejected.
    Repeated rows are repeated.
    """
    return _scan(docs, model or fit(docs, spec), spec, whole=True)


def mislabelled(docs: DataFrame, spec: LangSpec = LangSpec()) -> DataFrame:
    """(doc_id, lang): the languages covering at least ``spec.share`` of a document whose label doesn't name its one language.

    What is rejected is no language."""
    found = document_languages(docs, spec).where((F.col("share") >= spec.share) & (F.col("lang") != UNKNOWN))
    per = found.groupBy("doc_id").agg(F.collect_set("lang").alias("langs"), F.first("label").alias("label"))
    wrong = (F.size("langs") > 1) | F.col("label").isNull() | (F.col("label") != F.col("langs")[0])
    return per.where(wrong).select("doc_id", F.explode("langs").alias("lang"))
