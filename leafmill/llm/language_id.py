"""Language identification by Bayesian fusion of evidence.

A document's evidence is its text (likelihoods of hashed letter trigrams), the language that its markup or
record declares, the suffix of its address and its host.  The last three count by tables that are estimated
from all rows by grouped aggregation: how often a declaration or suffix goes with a language, smoothed, and
the share of languages of a host, smoothed towards its parent domain and that towards the whole.  A class of no
language, in which every trigram is as likely as any other, takes what isn't prose.

Where the label that the text model is fitted on is declared evidence as well, models are fitted in folds of the ids:
a document's text is scored by the model of the other folds, so that its own label isn't evidence twice.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import bounded, materialize, picked, slices, utf8

#: No language: what the background class is called.
NONE = "und"
BUCKETS = 1 << 15
#: Labelled rows of each label that the text model is fitted on, about; all rows of a label that has no more.
MAX_TRAINING = 4000
#: A label of so few rows has all of them in every fold's model, or some fold might not know it.
FEW = 200
#: Labels that a text model may have: a table of BUCKETS numbers for each reaches the driver.
MAX_LABELS = 256
#: Trigrams overlap and follow one another, so each counts as a part of one independent observation.
TEMPER = 0.25
#: Bytes scored at once.
SCORED = 1 << 22

# letters in lower case, everything else a space: of UTF-8's bytes the ASCII ones only
_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
for _c in b"abcdefghijklmnopqrstuvwxyz":
    _FOLD[_c] = _FOLD[_c - 32] = _c
_FOLDED = _FOLD.tobytes()


def trigram_buckets(data: np.ndarray) -> np.ndarray:
    """Bucket of the three bytes from each place on; multiply and shift, the same at every site."""
    x = data[:-2].astype(np.uint32)
    x <<= np.uint32(8)
    x |= data[1:-1]
    x <<= np.uint32(8)
    x |= data[2:]
    x *= np.uint32(2_654_435_761)
    x >>= np.uint32(32 - 15)
    return x


def folded(text: bytes) -> bytes:
    return b" " + text.translate(_FOLDED) + b" "


@dataclass(frozen=True)
class TextModel:
    """Log-likelihood of each bucket by language, over that of no language."""

    languages: tuple[str, ...]
    ratios: np.ndarray  # (BUCKETS, languages) float32; buckets of blanks only are nought

    def score(self, texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Sums of each text's ratios and its numbers of trigrams that count."""
        out, counts = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        blank = int(trigram_buckets(np.frombuffer(b"   ", np.uint8))[0])
        columns = [np.ascontiguousarray(self.ratios[:, k]) for k in range(len(self.languages))]
        for i, text in enumerate(texts):
            for at in range(0, len(text), SCORED):
                data = np.frombuffer(folded(text[at : at + SCORED]), np.uint8)
                buckets = trigram_buckets(data)
                counts[i] += len(buckets) - int(np.count_nonzero(buckets == blank))
                for k, column in enumerate(columns):
                    out[i, k] += float(column.take(buckets).sum(dtype=np.float64))
        return out, counts


def label_sample(rows: DataFrame, max_rows: int) -> DataFrame:
    """All rows of a label of at most ``max_rows``, else about so many, chosen by a hash of id and text; equal rows are chosen together.

    The row of a label's least hash is always chosen. Labels are counted over all rows; no text is shuffled
    while their table is small enough to broadcast.
    """
    rows = rows.withColumn("_hash", F.pmod(F.xxhash64("_id", "text"), F.lit(1 << 40)))
    labels = rows.groupBy("label").agg(F.count("*").alias("_n"), F.min("_hash").alias("_least"))
    upto = F.greatest(F.col("_least"), F.when(F.col("_n") <= max_rows, F.lit((1 << 40) - 1)).otherwise((F.lit(float(max_rows)) / F.col("_n") * (1 << 40)).cast("long")))
    labels = materialize(labels.select(F.col("label").alias("_label"), "_n", upto.alias("_upto")), "labels")
    if labels.count() > MAX_LABELS:
        raise ValueError(f"over {MAX_LABELS} labels; name those that are languages")
    return rows.join(bounded(labels), F.col("label") == F.col("_label")).where(F.col("_hash") <= F.col("_upto"))


def fold_of(identifier: Column, folds: int) -> Column:
    return F.pmod(F.xxhash64(identifier.cast("string"), F.lit("fold")), F.lit(folds)).cast("int")


def fit_text_models(docs: DataFrame, folds: int = 2, label_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", languages: Sequence[str] | None = None, max_rows: int = MAX_TRAINING, few: int = FEW) -> list[TextModel]:
    """A model for each fold of ids, fitted on the other folds' labelled rows; with one fold, on all rows.

    Fitted on about ``max_rows`` labelled rows of each label, and never none; a row without label or text isn't one.
    Counts are summed by Spark; what reaches the driver is BUCKETS numbers for each language and fold, of at most
    ``MAX_LABELS`` languages (checked).
    """
    rows = picked(docs, _id=id_col, text=text_col, label=label_col)
    rows = rows.select("_id", F.col("text").cast("string").alias("text"), F.col("label").cast("string").alias("label"))
    rows = rows.where(F.col("text").isNotNull() & F.col("label").isNotNull() & (F.col("label") != NONE))
    if languages is not None:
        rows = rows.where(F.col("label").isin(list(languages)))
    rows = label_sample(rows, max_rows)
    rows = rows.select("label", "text", F.when(F.col("_n") <= few, -1).otherwise(fold_of(F.col("_id"), folds)).alias("fold"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for b in slices(batches):
            for label, fold, text in zip(b.column("label").to_pylist(), b.column("fold").to_pylist(), utf8(b.column("text")), strict=True):
                # once a text, so that no text that repeats itself stands for its label
                got = np.zeros(BUCKETS, np.int64)
                for at in range(0, max(1, len(text)), SCORED):
                    got[trigram_buckets(np.frombuffer(folded(text[at : at + SCORED]), np.uint8))] = 1
                sums[label, fold] = sums.get((label, fold), 0) + got
        for (label, fold), got in sums.items():
            at = np.flatnonzero(got)
            columns = pa.array([label] * len(at), pa.string()), pa.array([fold] * len(at), pa.int32()), pa.array(at, pa.int32()), pa.array(got[at], pa.int64())
            yield pa.RecordBatch.from_arrays(list(columns), ["label", "fold", "bucket", "n"])

    counts = rows.mapInArrow(run, "label string, fold int, bucket int, n long").groupBy("label", "fold", "bucket").agg(F.sum("n").alias("n")).toPandas()
    found = tuple(sorted(counts["label"].unique()))
    models = []
    for k in range(folds):
        table = np.zeros((BUCKETS, len(found)))
        for j, label in enumerate(found):
            own = counts[(counts["label"] == label) & ((counts["fold"] != k) | (folds == 1))]
            np.add.at(table[:, j], own["bucket"].to_numpy(), own["n"].to_numpy())
        blank = int(trigram_buckets(np.frombuffer(b"   ", np.uint8))[0])
        table[blank] = 0
        likely = (table + 0.05) / (table.sum(0) + 0.05 * BUCKETS)
        ratios = np.log(likely * BUCKETS).astype(np.float32)
        ratios[blank] = 0
        models.append(TextModel(found, ratios))
    return models


def fit_text_model(docs: DataFrame, **options) -> TextModel:
    """One model of all labelled rows, for documents that aren't among them; options as of ``fit_text_models``."""
    return fit_text_models(docs, folds=1, **options)[0]


def parent_of(host: Column) -> Column:
    """The last two labels of a host of more, else the empty parent."""
    return F.when(F.size(F.split(host, r"\.")) > 2, F.substring_index(host, ".", -2)).otherwise(F.lit(""))


def identify(
    docs: DataFrame,
    model: TextModel | Sequence[TextModel],
    id_col: str = "doc_id",
    text_col: str = "text",
    declared_col: str | None = "lang",
    host_col: str | None = "source",
    suffix_col: str | None = None,
    prior_weight: float = 10.0,
    min_confidence: float = 0.5,
) -> DataFrame:
    """One row per document: doc_id, language, confidence, text_language, n_grams, accepted.

    language is the class of the greatest posterior, ``und`` if that is no language; accepted: a language, of
    at least ``min_confidence``.  A text that is null or without letters has no evidence of its own: it is
    ``und`` whatever is declared.  Several models are those of ``fit_text_models``, each for its fold of ids.  Ties go to the first language in alphabetical order; repeated rows give
    repeated results, rows of null id a result each, from one fold's model; an empty table gives none.  Texts are scored whole, a very
    long one in slices of ``SCORED`` bytes.
    """
    models = [model] if isinstance(model, TextModel) else list(model)
    names = [*models[0].languages, NONE]
    read = picked(docs, doc_id=id_col, text=text_col, declared=declared_col, host=host_col, suffix=suffix_col)
    extra = [F.coalesce(F.lower(F.col(c).cast("string")), F.lit("")).alias(c) for c in ("declared", "host", "suffix")]
    read = read.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra, fold_of(F.col("doc_id"), len(models)).alias("fold"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts, folds = utf8(b.column("text")), b.column("fold").to_numpy()
            sums, counts = np.zeros((len(texts), len(names) - 1)), np.zeros(len(texts), np.int64)
            for k, one in enumerate(models):
                own = np.flatnonzero(folds == k)
                sums[own], counts[own] = one.score([texts[i] for i in own])
            likely = np.hstack([TEMPER * sums, np.zeros((len(counts), 1))])
            arrays = [b.column("doc_id"), b.column("declared"), b.column("host"), b.column("suffix"), pa.array(counts, pa.int64()), pa.array(list(likely), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "declared", "host", "suffix", "n_grams", "likely"])

    scored = read.mapInArrow(run, "doc_id long, declared string, host string, suffix string, n_grams long, likely array<double>")
    rows = materialize(scored.withColumn("text_class", F.expr("cast(array_position(likely, array_max(likely)) - 1 as int)")), "language")

    # counts of classes, one row for each value; sums before the shuffle, so a hot host is one row a task
    number = len(names)
    per_class = lambda prefix: [F.count_if(F.col("text_class") == k).alias(f"{prefix}{k}") for k in range(number)]
    total = rows.agg(*per_class("t"))
    smoothed = lambda n, base: (n + prior_weight * base)
    hosts = rows.groupBy("host").agg(*per_class("h")).withColumn("parent", parent_of(F.col("host")))
    parents = hosts.groupBy("parent").agg(*(F.sum(f"h{k}").alias(f"p{k}") for k in range(number)))

    # total is one row of a number for each class: it becomes literals
    got = total.first()
    everything = max(1, sum(got[f"t{k}"] or 0 for k in range(number)))
    overall = [((got[f"t{k}"] or 0) + 1.0) / (everything + number) for k in range(number)]

    of_parent = F.array(*(smoothed(F.col(f"p{k}"), overall[k]) for k in range(number)))
    parents = parents.select("parent", F.transform(of_parent, lambda x: x / F.aggregate(of_parent, F.lit(0.0), lambda a, b: a + b)).alias("_parent"))
    of_host = F.array(*(smoothed(F.col(f"h{k}"), F.col("_parent")[k]) for k in range(number)))
    # written tables of known size: Spark broadcasts them while they are small and splits hot hosts beyond
    priors = hosts.join(parents, "parent").select("host", F.transform(of_host, lambda x: F.log(x / F.aggregate(of_host, F.lit(0.0), lambda a, b: a + b))).alias("_prior"))

    def evidence(column: str) -> DataFrame:
        """log P(value | class), the empty value telling nothing."""
        per = rows.where(F.col(column) != "").groupBy(column).agg(*per_class("v"))
        table = F.array(*(F.log((F.col(f"v{k}") + prior_weight * 0.01) / (F.lit(float(got[f"t{k}"] or 0)) + prior_weight)) for k in range(number)))
        return materialize(per.select(column, table.alias(f"_{column}")), column)

    def held(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit([0.0] * number))

    joined = rows.join(materialize(priors, "priors"), "host", "left")
    parts = [held("_prior")]
    for column, given in (("declared", declared_col), ("suffix", suffix_col)):
        if given:
            joined = joined.join(evidence(column), column, "left")
            parts.append(held(f"_{column}"))
    fused = F.array(*(sum((p[k] for p in parts), F.col("likely")[k]) for k in range(number)))
    post = F.array_max("_fused")
    share = 1.0 / F.aggregate(F.transform("_fused", lambda x: F.exp(x - post)), F.lit(0.0), lambda a, b: a + b)
    best = F.when(F.col("n_grams") == 0, F.lit(number)).otherwise(F.array_position("_fused", post).cast("int"))
    labels = F.array(*map(F.lit, names))
    return (
        joined.withColumn("_fused", fused)
        .select("doc_id", F.element_at(labels, best).alias("language"), F.when(F.col("n_grams") == 0, 1.0).otherwise(share).alias("confidence"), labels[F.col("text_class")].alias("text_language"), "n_grams")
        .withColumn("accepted", (F.col("language") != NONE) & (F.col("confidence") >= min_confidence))
    )


def page_columns(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages with text, declared markup language, host and address suffix: its last label."""
    url, html = F.coalesce(F.col(url_col), F.lit("")), F.coalesce(F.col(html_col), F.lit(""))
    bare = F.regexp_replace(html, r"(?is)<(script|style|nav)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    host = F.lower(F.regexp_extract(url, r"://([^/?#]*)", 1))
    declared = F.lower(F.regexp_extract(html, r"""(?i)<html[^>]*?\blang\s*=\s*["']?([A-Za-z]{2,3})""", 1))
    return pages.withColumns({"_text": bare, "_declared": declared, "_host": host, "_suffix": F.substring_index(host, ".", -1)})
