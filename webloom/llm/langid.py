"""Language identification by error-correcting output codes.

Each language has a codeword; each bit of it is predicted by a binary classifier of character n-grams, and the language
whose codeword has the least loss, weighted by the margins of the bits, is chosen. A single wrong bit is corrected, and
a text whose two best codewords are nearly as good is flagged as ambiguous.

N-grams are counted in hash buckets, so a text of any length becomes one vector of fixed size and the bits of a batch
are one matrix product. Training uses a bounded sample per language; prediction reads every text whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.hashing import U64, prefix_hashes, span_hashes
from webloom.operators.batches import pieces
from webloom.operators.ranking import ranked_per_key

UNDETERMINED = "und"
#: Training documents per language, at most.
SAMPLE_PER_LANGUAGE = 800
BUCKET_BITS = 13
GRAMS = (1, 2, 3)
#: Share of the loss by which the best codeword must beat the second.
AMBIGUOUS = 0.02
#: Languages a model may learn, at most; a table with more is refused rather than trained on a part.
MAX_LANGUAGES = 64
_MAX_BITS = 63


class Model(NamedTuple):
    languages: list[str]
    codes: np.ndarray  # (languages, bits) of +1 and -1
    weights: np.ndarray  # (buckets, bits)
    scale: np.ndarray  # bits: what brings a mean margin to about 1


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(3)) == 1


def counts_of(texts: list[str]) -> np.ndarray:
    """N-gram counts in buckets, one row per text, each n-gram length summing to 1. A text is lower-cased, and what is
    not a letter counts as a space."""
    buckets = 1 << BUCKET_BITS
    result = np.zeros((len(texts), buckets), np.float32)
    for row, text in enumerate(texts):
        symbols = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        plain = symbols < 128
        symbols = np.where(plain & ~((symbols >= 97) & (symbols <= 122)), 32, symbols)
        symbols = symbols[np.concatenate([[True], (symbols[1:] != 32) | (symbols[:-1] != 32)])] if len(symbols) else symbols
        sums = prefix_hashes(symbols)
        for n in GRAMS:
            if len(symbols) < n:
                continue
            start = np.arange(len(symbols) - n + 1)
            at = (span_hashes(sums, start, start + n) >> U64(64 - BUCKET_BITS)).astype(np.int64)
            result[row] += np.bincount(at, minlength=buckets).astype(np.float32) / np.float32(len(at))
    return result


def codewords(n: int) -> np.ndarray:
    """A matrix of +1 and -1 with a row per language. Up to seven languages get every split of the languages in two;
    more get splits drawn with a fixed seed, the most distant of several tries."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        splits = range(1, 1 << (n - 1))
        return np.array([[1 if language == n - 1 or not split >> language & 1 else -1 for split in splits]
                         for language in range(n)])
    rng, best, distance = np.random.default_rng(7), None, -1
    for _ in range(200):
        tried = np.where(rng.random((n, _MAX_BITS)) < 0.5, 1, -1)
        tried = tried[:, np.abs(tried.sum(axis=0)) < n]
        least = min(int((a != b).sum()) for i, a in enumerate(tried) for b in tried[:i])
        if least > distance:
            best, distance = tried, least
    return best


def fit(docs: DataFrame, usable: Column, id_column: str = "doc_id", text_column: str = "text",
        language_column: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """A model from at most ``per_language`` usable documents of each non-null language, those with the least hashes.
    Rows that repeat an id and its text count once; several texts under one chosen id all count. More than
    ``MAX_LANGUAGES`` languages is an error. An empty table gives a model without languages.

    Bits are naive Bayes classifiers: the weight of an n-gram is the logarithm of its share among the languages with
    the bit over its share among the others, languages counting alike.
    """
    rows = docs.filter(usable & F.col(language_column).isNotNull() & F.col(text_column).isNotNull()).select(
        F.col(id_column).alias("sample_id"), F.col(language_column).alias("sample_lang"))
    chosen = ranked_per_key(rows.withColumn("h", F.xxhash64("sample_id")), ["sample_lang"],
                            [F.asc("h"), F.asc("sample_id")], per_language).select("sample_id", "sample_lang").distinct()
    n_languages = chosen.select("sample_lang").distinct().count()
    if n_languages > MAX_LANGUAGES:
        raise ValueError(f"{n_languages} languages; at most MAX_LANGUAGES = {MAX_LANGUAGES} can be learnt")
    buckets = 1 << BUCKET_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in pieces(batches, 1):
            languages = batch.column(0).to_pylist()
            counts = counts_of(batch.column(1).to_pylist())
            for language in set(languages):
                own = counts[[x == language for x in languages]].sum(axis=0, dtype=np.float64)
                sums[language] = sums.get(language, 0.0) + own
        for language, total in sums.items():
            used = np.flatnonzero(total)
            # Whole numbers add up alike in any order.
            yield pa.RecordBatch.from_arrays(
                [pa.array([language] * len(used)), pa.array(used), pa.array(np.rint(total[used] * 2 ** 30).astype(np.int64))],
                ["lang", "bucket", "n"])

    # The sample has at most ``per_language`` ids a language, whatever the input.
    # Rows that repeat a chosen id and its text count once, so the sample is bounded in rows, not only in ids.
    sample = docs.join(F.broadcast(chosen), (docs[id_column] == chosen["sample_id"])
                       & (docs[language_column] == chosen["sample_lang"])).filter(usable).dropDuplicates(
        ["sample_id", "sample_lang", text_column])
    counted = sample.select(F.col(language_column).alias("lang"), F.coalesce(F.col(text_column), F.lit("")).alias("text")) \
        .mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r["lang"] for r in counted})
    totals = np.zeros((len(languages), buckets))
    place = {x: i for i, x in enumerate(languages)}
    for r in counted:
        totals[place[r["lang"]], r["bucket"]] = r["n"]
    shares = totals / np.maximum(totals.sum(axis=1, keepdims=True), 1)
    shares = (shares + 1e-7) / (1 + 1e-7 * buckets)
    codes = codewords(len(languages))
    weights = np.zeros((buckets, codes.shape[1] if len(languages) else 1), np.float32)
    if len(languages) > 1:
        for bit in range(codes.shape[1]):
            yes, no = shares[codes[:, bit] > 0].mean(axis=0), shares[codes[:, bit] < 0].mean(axis=0)
            weights[:, bit] = np.log(yes / no)
    # The margin of a language's own n-grams, averaged over languages.
    margins = np.abs(shares @ weights)
    return Model(languages, codes, weights, np.maximum(margins.mean(axis=0), 1e-6) if len(languages) else np.ones(1))


def decide(model: Model, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
    """(language, score, ambiguous) of each text. A text that is null or has no letter is undetermined with score 0."""
    known = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
    names, scores, unsure = [UNDETERMINED] * len(texts), [0.0] * len(texts), [True] * len(texts)
    if not known or not model.languages:
        return names, scores, unsure
    margins = counts_of([texts[i] for i in known]) @ model.weights / (len(GRAMS) * model.scale)
    # Exponential loss of each codeword; margins are held to a range so no single bit decides.
    held = np.clip(3 * margins, -6, 6)
    loss = np.exp(-held[:, None, :] * model.codes[None, :, :]).mean(axis=2)
    chance = 1 / loss
    chance /= chance.sum(axis=1, keepdims=True)
    best = np.argmax(chance, axis=1)
    ordered = np.sort(loss, axis=1)
    for row, i in enumerate(known):
        names[i] = model.languages[best[row]]
        scores[i] = float(chance[row, best[row]])
        unsure[i] = bool(len(model.languages) > 1 and ordered[row, 1] - ordered[row, 0] < AMBIGUOUS * ordered[row, 1])
    return names, scores, unsure


def identify(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: (row, lang_pred, score, ambiguous), ``row`` being all its columns.

    Predictions depend on the text alone. Repeated rows get the same prediction each; an empty table gives an empty
    result.
    """
    return docs.select(F.struct(*docs.columns).alias("row"), predicted(model)(F.col(text_column).cast("string")).alias("p")) \
        .select("row", "p.*")


def predicted(model: Model):
    """A column function: text to struct(lang_pred, score, ambiguous). Only texts go to Python."""

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        parts = [decide(model, texts.iloc[a:a + 256].tolist()) for a in range(0, len(texts), 256)]
        columns = [[x for part in parts for x in part[i]] for i in range(3)]
        return pd.DataFrame(dict(zip(("lang_pred", "score", "ambiguous"), columns)))

    return predict


def drop_unidentified(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                      language_column: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose language is found and not ambiguous, with all their columns."""
    model = fit(docs, F.lit(True), id_column, text_column, language_column)
    return identify(docs, model, id_column, text_column).filter(
        (F.col("lang_pred") != UNDETERMINED) & ~F.col("ambiguous")).select("row.*")
