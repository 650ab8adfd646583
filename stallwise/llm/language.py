"""Language of documents and of the segments of mixed ones, with a confidence.

Nearest-centroid classification: sentences become normalised TF-IDF vectors of hashed character n-grams and are compared
by cosine with several clustered centroids per language; what is too far from every centroid, or as near to two
languages, is rejected and follows its neighbours. Document frequencies come from all documents. The centroids are
fitted on a bounded sample of labelled documents; labels that the first, single centroids contradict are not believed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tokens import spread

# Names and codes of languages, all for the two-letter code before the colon.
LABELS = """
en: eng english; sw: swa swh swahili kiswahili; fr: fra fre french français francais; es: spa spanish español espanol castellano
pt: por portuguese português portugues; de: deu ger german deutsch; ar: ara arabic العربية; zh: zho chi cmn chinese mandarin 中文 汉语
it: ita italian italiano; nl: nld dut dutch nederlands; ru: rus russian русский; tr: tur turkish türkçe; pl: pol polish polski
sv: swe swedish svenska; da: dan danish dansk; no: nor nob nb norwegian norsk; fi: fin finnish suomi; cs: ces cze czech čeština
el: ell gre greek ελληνικά; he: heb hebrew עברית; hi: hin hindi हिन्दी; bn: ben bengali; ur: urd urdu; fa: fas per persian farsi
ja: jpn japanese 日本語; ko: kor korean 한국어; vi: vie vietnamese; id: ind indonesian; ms: msa may malay; th: tha thai
uk: ukr ukrainian; ro: ron rum romanian; hu: hun hungarian magyar; am: amh amharic; so: som somali; yo: yor yoruba
ha: hau hausa; ig: ibo igbo; zu: zul zulu; af: afr afrikaans; rw: kin kinyarwanda; lg: lug luganda ganda
und: und undetermined zxx mul
"""
NO_LANGUAGE = "und"

BUCKETS = 1 << 14  #: hashed n-grams
ORDERS = (1, 2, 3, 4)
SAMPLE_DOCUMENTS = 400  #: labelled documents a language, at most, for the centroids
SAMPLE_SENTENCES = 6  #: sentences of each of them
LEAST_DOCUMENTS = 5  #: labelled documents that a language needs
CENTROIDS = 4
SHRINKAGE = 0.7  #: weight of a language's mean in its centroids
ROUNDS = 8
LEAST_LETTERS = 10  #: letters in words that a sentence needs for a language of its own
LEAST_COSINE = 0.09
LEAST_MARGIN = 0.06  #: lead over the next language, as a share of the cosine
PIECE = 300_000  #: characters a worker turns into vectors at once

_SENTENCE = re.compile(r"(?<=[.!?؟…])[\"'”’»)\]]*\s+|(?<=[。！？])|[\r\n]+")
_MARKUP = re.compile(r"<[^<>]{1,200}>|&[a-z]{2,8};|&#\d{1,6};|https?://\S+|www\.\S+|\S+@\S+\.\S+", re.I)
_CODED = re.compile(r"(?<![A-Za-z0-9])(?=[A-Za-z]*[0-9])[A-Za-z0-9]+|(?<![A-Za-z])[A-Z]{1,4}(?=[^\w]*[0-9])|(?<=[0-9])\s?[A-Za-z]{1,3}(?![A-Za-z])")
_OTHER = re.compile(r"[\W\d_]+")


def label_codes() -> dict[str, str]:
    codes = {}
    for part in re.split(r"[;\n]", LABELS):
        code, _, names = part.strip().partition(":")
        if code:
            codes |= {name: code for name in [code, *names.split()]}
    return codes


def label_language(label: Column) -> Column:
    """The language code that a label in any notation names, or null."""
    first = F.regexp_extract(F.lower(F.trim(label)), r"^([\p{L}\p{M}]+)", 1)
    pairs = [F.lit(x) for pair in label_codes().items() for x in pair]
    return F.create_map(*pairs)[first]


def sentences(text: str) -> list[str]:
    """The text's sentences in order; lines end sentences too."""
    return [s for s in _SENTENCE.split(text) if s and s.strip()]


def words_of(sentence: str) -> str:
    """The sentence's words in lower case between single blanks, without markup, addresses, figures and codes."""
    if "<" in sentence or "&" in sentence or "." in sentence or "@" in sentence:
        sentence = _MARKUP.sub(" ", sentence)
    if any(c.isdigit() for c in sentence):
        sentence = _CODED.sub(" ", sentence)
    return f" {_OTHER.sub(' ', sentence.lower()).strip()} "


class Vectors(NamedTuple):
    """Sparse rows: for each entry its row and bucket, and its count."""

    rows: np.ndarray
    buckets: np.ndarray
    counts: np.ndarray
    n: int


def count_ngrams(texts: list[str]) -> Vectors:
    """Counts of hashed n-grams by text; an n-gram never spans two texts."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    row = np.repeat(np.arange(len(texts)), lengths)
    keys, rolled = [], np.zeros(len(points), dtype=np.uint64)
    for order in range(1, max(ORDERS) + 1):
        size = len(points) - order + 1
        if size <= 0:
            break
        rolled = rolled[:size] * np.uint64(0x100000001B3) + points[order - 1 :] + np.uint64(order)
        if order in ORDERS:
            whole = row[:size] == row[order - 1 :]
            mixed = rolled * np.uint64(0x9E3779B97F4A7C15)
            bucket = (mixed >> np.uint64(64 - 14)).astype(np.int64)
            keys.append((row[:size] * BUCKETS + bucket)[whole])
    found, counts = np.unique(np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64), return_counts=True)
    return Vectors(found // BUCKETS, found % BUCKETS, counts, len(texts))


class Model(NamedTuple):
    idf: np.ndarray
    centroids: np.ndarray  #: a column for each, normalised
    languages: list[str]  #: of each centroid

    def weights(self, v: Vectors) -> np.ndarray:
        """TF-IDF values, each row of length 1."""
        values = (1 + np.log(v.counts)) * self.idf[v.buckets]
        norms = np.sqrt(np.bincount(v.rows, values * values, minlength=v.n))
        return values / np.maximum(norms, 1e-12)[v.rows]

    def cosines(self, v: Vectors) -> np.ndarray:
        """Cosine of each row with each centroid."""
        values, out = self.weights(v), np.zeros((v.n, self.centroids.shape[1]), dtype=np.float32)
        starts = np.flatnonzero(np.diff(v.rows, prepend=-1))
        if len(starts):
            out[v.rows[starts]] = np.add.reduceat(self.centroids[v.buckets] * values[:, None].astype(np.float32), starts, axis=0)
        return out

    def by_language(self, cosines: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The best cosine by language."""
        known = sorted(set(self.languages))
        owners = np.array(self.languages)
        return known, np.stack([cosines[:, owners == k].max(axis=1) for k in known], axis=1)


def _dense(model: Model, v: Vectors) -> np.ndarray:
    out = np.zeros((v.n, BUCKETS), dtype=np.float32)
    out[v.rows, v.buckets] = model.weights(v)
    return out


def _clustered(rows: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from evenly spaced rows; columns are the normalised centres."""
    centres = rows[np.linspace(0, len(rows) - 1, min(k, len(rows))).astype(int)]
    for _ in range(ROUNDS):
        near = (rows @ centres.T).argmax(axis=1)
        sums = np.stack([rows[near == i].sum(axis=0) if (near == i).any() else centres[i] for i in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres.T


def _document_frequencies(documents: DataFrame) -> np.ndarray:
    """Documents that hold each bucket, over all documents; the result has ``BUCKETS`` rows at most."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(BUCKETS + 1, dtype=np.int64)
        for batch in batches:
            for piece in _pieces([words_of(t) for t in batch["text"] if isinstance(t, str)]):
                vectors = count_ngrams(piece)
                seen[:BUCKETS] += np.bincount(vectors.buckets, minlength=BUCKETS)
                seen[BUCKETS] += len(piece)
        held = np.flatnonzero(seen)
        yield pd.DataFrame({"bucket": held, "documents": seen[held]})

    counted = documents.select("text").mapInPandas(count, "bucket long, documents long")
    rows = counted.groupBy("bucket").agg(F.sum("documents").alias("documents")).collect()
    frequencies = np.zeros(BUCKETS + 1)
    for bucket, n in rows:
        frequencies[bucket] = n
    return frequencies


def _pieces(texts: list[str]) -> Iterator[list[str]]:
    """The texts in groups of about ``PIECE`` characters; a longer text is a group of its own."""
    piece, size = [], 0
    for text in texts:
        if piece and size + len(text) > PIECE:
            yield piece
            piece, size = [], 0
        piece.append(text)
        size += len(text)
    if piece:
        yield piece


def _first_sentences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The first ``SAMPLE_SENTENCES`` sentences of each text that have words enough, as words."""
    for batch in batches:
        usable = [[w for s in sentences(t) if len((w := words_of(s)).strip()) >= 20][:SAMPLE_SENTENCES] for t in batch["text"]]
        yield pd.DataFrame({"language": batch["language"], "place": batch["place"], "usable": usable})


def fit(documents: DataFrame) -> Model | None:
    """The model, or None if no language has enough labelled documents. ``documents``: doc_id, text, lang.

    Frequencies over all documents; centroids from at most ``SAMPLE_DOCUMENTS`` documents a language, those with the
    smallest hash of their id, and the first ``SAMPLE_SENTENCES`` sentences of each. Labelled languages are at most as
    many as ``LABELS`` names.
    """
    frequencies = _document_frequencies(documents)
    idf = np.log((1 + frequencies[BUCKETS]) / (1 + frequencies[:BUCKETS])) + 0.01
    labelled = documents.withColumn("language", label_language(F.col("lang"))).filter(f"language != '{NO_LANGUAGE}' AND length(trim(text)) > 40")
    order = W.partitionBy("language").orderBy(F.xxhash64("doc_id"), "doc_id")
    sample = labelled.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= SAMPLE_DOCUMENTS)
    rows = sample.select("language", "place", "text").mapInPandas(_first_sentences, "language string, place int, usable array<string>").orderBy("language", "place").collect()
    texts: dict[str, list[str]] = {}
    for language, _, usable in rows:
        texts.setdefault(language, []).extend(usable)
    texts = {k: v for k, v in sorted(texts.items()) if len(v) >= LEAST_DOCUMENTS}
    if not texts:
        return None
    return fit_texts(idf, texts)


def fit_texts(idf: np.ndarray, texts: dict[str, list[str]]) -> Model | None:
    """The model of labelled sentences, or None without enough of them.

    Labels can be wrong: sentences that the languages' means contradict are left out, until a round contradicts no more.
    A centroid lies between its cluster and the mean of its language by ``SHRINKAGE``, so that what a cluster's sentences
    are about, which other languages write of too, weighs less than how the language is written.
    """
    languages, counted = list(texts), [count_ngrams(v) for v in texts.values()]
    model = Model(idf, np.zeros((BUCKETS, 1), dtype=np.float32), languages)
    weights = [model.weights(v) for v in counted]
    believed = [np.ones(v.n, dtype=bool) for v in counted]
    for _ in range(ROUNDS):
        sums = [np.bincount(v.buckets, w * held[v.rows], minlength=BUCKETS) for v, w, held in zip(counted, weights, believed)]
        means = np.stack([m / max(np.linalg.norm(m), 1e-12) for m in sums], axis=1)
        by_means = Model(idf, means.astype(np.float32), languages)
        following = [by_means.cosines(v).argmax(axis=1) == i for i, v in enumerate(counted)]
        if all((f == b).all() for f, b in zip(following, believed)):
            break
        believed = following
    columns, owners = [], []
    for i, language in enumerate(languages):
        if believed[i].sum() >= LEAST_DOCUMENTS:
            centres = (1 - SHRINKAGE) * _clustered(_dense(model, counted[i])[believed[i]], CENTROIDS) + SHRINKAGE * means[:, [i]]
            columns.append(centres / np.linalg.norm(centres, axis=0))
            owners += [language] * centres.shape[1]
    return Model(idf.astype(np.float64), np.concatenate(columns, axis=1).astype(np.float32), owners) if columns else None


def _decide(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """For each sentence: cosines by language, whether it is sure, and its confidence."""
    cosines = np.concatenate([model.cosines(count_ngrams(p)) for p in _pieces(texts)]) if texts else np.zeros((0, len(model.languages)))
    known, best = model.by_language(cosines)
    ordered = np.sort(best, axis=1)
    top = ordered[:, -1]
    second = ordered[:, -2] if best.shape[1] > 1 else np.zeros(len(top))
    lead = (top - second) / np.maximum(top, 1e-9)
    letters = np.array([sum(len(w) for w in t.split() if len(w) > 1 or w > "⺀") * (1 if t.isascii() or max(t) < "⺀" else 3) for t in texts])
    sure = (letters >= LEAST_LETTERS) & (top >= LEAST_COSINE) & (lead >= LEAST_MARGIN)
    confidence = np.clip(0.5 + lead, 0, 1) * np.clip(top / 0.3, 0.3, 1)
    return known, best, sure, confidence


def segments_of(model: Model, texts: list[str | None]) -> list[list[tuple[str, float, int]]]:
    """For each text its segments in order: language, confidence (0 to 1) and number of sentences.

    A sentence that is rejected takes the language of the sure one before or after it, whichever it is nearer to. A text
    without a sure sentence is judged as a whole, more leniently; without words enough, or far from all languages, it
    has no language. Null and blank texts have no segments.
    """
    split = [sentences(t) if t and t.strip() else [] for t in texts]
    known, best, sure, confidence = _decide(model, [words_of(s) for ss in split for s in ss])
    out, at = [], 0
    for ss in split:
        if not ss:
            out.append([])
            continue
        span = slice(at, at + len(ss))
        scores, certain, trust = best[span], sure[span], confidence[span]
        at += len(ss)
        if not certain.any():
            whole = words_of(" ".join(ss))
            _, pooled, _, level = _decide(model, [whole])
            enough = sum(len(w) for w in whole.split() if len(w) > 2 or w > "⺀") >= 5
            language = known[int(pooled[0].argmax())] if enough and pooled[0].max() >= LEAST_COSINE else NO_LANGUAGE
            out.append([(language, float(level[0]), len(ss))])
            continue
        names = scores.argmax(axis=1)
        held = np.flatnonzero(certain)
        for i in np.flatnonzero(~certain):
            place = np.searchsorted(held, i)
            around = [held[j] for j in (place - 1, place) if 0 <= j < len(held)]
            names[i] = names[max(around, key=lambda j: scores[i, names[j]])]
        found: list[list] = []
        for i, name in enumerate(names):
            if not found or found[-1][0] != name:
                found.append([name, [], 0])
            if certain[i]:
                found[-1][1].append(trust[i])
            found[-1][2] += 1
        out.append([(known[n], float(np.mean(t)) if t else 0.0, k) for n, t, k in found])
    return out


def language_segments(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """All segments of all documents: ``doc_id``, ``seg_no`` from 0, ``lang``, ``confidence``, ``n_sentences``,
    ``n_segments`` (of the document) and ``label``.

    ``documents`` has doc_id, text and lang; ``label`` is the code that lang names, null if it names none. Null and
    blank texts give no rows; repeated documents give theirs again. Without any labelled language every text is 'und'.
    """
    source = spread(documents.select("doc_id", "text", "lang"))
    model = fit(source)
    shared = spark.sparkContext.broadcast(model)  # of fixed size: buckets times centroids

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fitted = shared.value
        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch["text"]]
            at = 0
            while at < len(texts):
                size, end = 0, at
                while end < len(texts) and (end == at or size + len(texts[end] or "") <= PIECE):
                    size += len(texts[end] or "")
                    end += 1
                if fitted is None:
                    found = [[(NO_LANGUAGE, 0.0, 1)] if t and t.strip() else [] for t in texts[at:end]]
                else:
                    found = segments_of(fitted, texts[at:end])
                rows = [
                    (doc, i, *segment, len(segments), label)
                    for doc, label, segments in zip(batch["doc_id"][at:end], batch["label"][at:end], found)
                    for i, segment in enumerate(segments)
                ]
                yield pd.DataFrame(rows, columns=["doc_id", "seg_no", "lang", "confidence", "n_sentences", "n_segments", "label"])
                at = end

    schema = "doc_id long, seg_no long, lang string, confidence double, n_sentences long, n_segments long, label string"
    return source.select("doc_id", "text", label_language(F.col("lang")).alias("label")).mapInPandas(work, schema)


def wrongly_labelled(segments: DataFrame) -> DataFrame:
    """The segments of documents that are mixed or whose label is missing or names another language."""
    right = F.coalesce(F.col("label") == F.col("lang"), F.lit(False))
    return segments.filter((F.col("n_segments") > 1) | ~right)
