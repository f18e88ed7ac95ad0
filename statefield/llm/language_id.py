"""Language ID by Bayesian evidence fusion.

The text gives likelihoods by naive Bayes over hashed character trigrams, tempered because neighbouring trigrams tell much
the same. Declared markup language and address suffix give likelihoods by fixed tables of trust. The prior is that of the
host, smoothed by its domain, that by its suffix, that by all rows; grouped aggregations add up the rows' own posteriors,
pre-aggregated, so a host with a third of all rows is no burden. A row's prior leaves out what the row itself adds, at
every level, so its evidence counts once. The fused posterior gives language and confidence; rows without letters, or
below the least confidence, are rejected.

The trigram model is fitted on at most TRAIN_ROWS labelled rows of each language, those whose digests are the smallest;
everything else covers all rows and whole texts.

Defined results: null or empty texts, and texts without letters, have no text evidence and are rejected; null declared
language or address gives no evidence; repeated rows get one result each; ties go to the language first by name. Empty
tables give no rows. Without labelled rows no language is known: rows then have a null language and confidence 0, and only
those without letters are rejected. Columns of any name pass by, as only the named ones are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import known_size, materialise, small_batches, tidy
from .dom import blocks

TRAIN_ROWS = 1000
BITS = 16
#: Characters looked at together.
SLICE = 1 << 16
#: Share of the trigram evidence that counts, and the most it may count for (natural logarithm).
TEMPER, MOST = 0.2, 40.0
#: Trust in a declared language, in a national suffix.
DECLARED, SUFFIX = 0.85, 0.7
#: Rows that each level of the prior counts as, against the level above.
STRENGTH = 10.0
LEAST = 0.5
#: Suffixes of countries and their main language.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "co": "es", "cl": "es", "uk": "en", "us": "en", "au": "en", "ie": "en", "nz": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "ru": "ru", "jp": "ja", "cn": "zh"}


@dataclass(frozen=True)
class TextModel:
    """languages, and log-probabilities of hashed trigrams, one row for each language."""

    languages: tuple[str, ...]
    table: np.ndarray

    def evidence(self, text: str) -> tuple[np.ndarray, int]:
        """Log-likelihood of each language, largest zero, and the number of trigrams with a letter."""
        ll, n = np.zeros(len(self.languages)), 0
        for h in trigrams(text):
            ll += self.table[:, h].sum(1, dtype=np.float64) * TEMPER
            n += len(h)
        return (np.maximum(ll - ll.max(), -MOST) if len(ll) else ll), n


def trigrams(text: str) -> Iterator[np.ndarray]:
    """Hashes of the character trigrams of lower-cased words, some at a time; digits and punctuation count as spaces."""
    spaced = f" {text.lower()} "
    for s in range(0, len(spaced) - 2, SLICE):
        a = np.frombuffer(spaced[s : s + SLICE + 2].encode("utf-32-le", "surrogatepass"), "<u4")
        letter = ((a >= 97) & (a <= 122)) | (a >= 0xAA) & ~((a >= 0x2000) & (a <= 0x206F)) & (a != 0xD7) & (a != 0xF7) & (a != 0xAB) & (a != 0xBB) & (a != 0xB7)
        a = np.where(letter, a, 32).astype(np.uint64)
        keep = letter[:-2] | letter[1:-1] | letter[2:]
        h = (a[:-2] * np.uint64(0x9E3779B1) ^ a[1:-1] * np.uint64(0x85EBCA77) ^ a[2:] * np.uint64(0xC2B2AE3D)) * np.uint64(0x9E3779B97F4A7C15)
        yield (h[keep] >> np.uint64(64 - BITS)).astype(np.int64)


def training_rows(labelled: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """lang, text of at most `rows` rows of each language, those with the smallest digests of id and text; repeated ones count once.

    Numbers of rows give a threshold of the digest first, so that only about twice as many light rows are ranked and only the
    texts of the chosen ones are moved.
    """
    digest = F.xxhash64("id", "text")
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", digest.alias("digest"))
    light = usable.select("lang", "digest")
    share = 2.0 * rows / F.col("n") * 2.0**64 - 2.0**63
    counts = materialise(light.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "language-counts")
    low = light.join(known_size(counts), "lang").where(F.col("digest").cast("double") <= share).select("lang", "digest").distinct()
    ranked = low.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("digest"))).where(F.col("k") <= rows).select("lang", "digest")
    chosen = materialise(ranked, "language-sample")
    return usable.join(known_size(chosen), ["lang", "digest"], "left_semi").dropDuplicates(["lang", "digest"]).select("lang", "text")


def fit_text(labelled: DataFrame, rows: int = TRAIN_ROWS, least: int = 5, spread: int = 8) -> TextModel:
    """labelled: id, text, lang. Languages with fewer than `least` rows are left out, unless all have fewer; no rows give no languages."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, tuple[np.ndarray, int]] = {}
        for b in small_batches(batches, "text"):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                counts, n = found.get(lang, (np.zeros(1 << BITS, np.int64), 0))
                for h in trigrams(text):
                    counts += np.bincount(h, minlength=1 << BITS)
                found[lang] = counts, n + 1
        for lang, (counts, n) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([n]), pa.array([counts.tobytes()], pa.binary())], ["lang", "n", "counts"])

    totals: dict[str, np.ndarray] = {}
    seen: dict[str, int] = {}
    sample = training_rows(labelled, rows).repartition(spread, F.xxhash64("text"))
    for r in sample.mapInArrow(tidy(count), "lang string, n long, counts binary").toLocalIterator():
        totals[r.lang] = totals.get(r.lang, 0) + np.frombuffer(r.counts, np.int64)
        seen[r.lang] = seen.get(r.lang, 0) + r.n
    languages = tuple(sorted(x for x in totals if seen[x] >= least)) or tuple(sorted(totals))
    if not languages:
        return TextModel((), np.zeros((0, 1 << BITS), np.float32))
    c = np.stack([totals[x] for x in languages]) + 0.5
    return TextModel(languages, np.log(c / c.sum(1, keepdims=True)).astype(np.float32))


def plain_text(markup: str) -> str:
    """The text of a page's blocks, character references decoded; scripts, styles, titles and comments give none."""
    return "\n".join(b.text for b in blocks(markup))


def declared_in(markup: Column) -> Column:
    """The lang attribute of a page's first html tag."""
    text = F.coalesce(markup, F.lit(""))
    at = F.instr(F.lower(text), F.lit("<html"))
    tag = F.when(at > 0, F.substring_index(F.substr(text, at), ">", 1)).otherwise(F.lit(""))
    return F.regexp_extract(tag, r"(?i)\blang\s*=\s*[\"']?([A-Za-z]+)", 1)


def _levels(address: Column) -> tuple[Column, Column, Column]:
    """host, domain (its last two labels) and suffix of an address, or of a bare source name."""
    a = F.lower(F.coalesce(address, F.lit("")))
    host = F.regexp_extract(a, r"^(?:[a-z][a-z0-9+.-]*://)?([^/?#:]*)", 1)
    domain = F.regexp_extract(host, r"([^.]*\.[^.]*)$", 1)
    return host, F.when(domain == "", host).otherwise(domain), F.regexp_extract(host, r"\.([^.]*)$", 1)


def _logs(languages: tuple[str, ...], told: Column, trust: float) -> Column:
    """log P(told | language) for each language; zero where nothing, or no known language, is told."""
    other = math.log((1 - trust) / max(1, len(languages) - 1))
    known = F.coalesce(told.isin(*languages), F.lit(False))
    return F.array(*(F.when(~known, F.lit(0.0)).when(told == x, F.lit(math.log(trust))).otherwise(F.lit(other)) for x in languages))


def _once(c: Column, f) -> Column:
    """f(c), where c is worked out once however often f refers to it."""
    return F.transform(F.array(c), f)[0]


def _softmax(scores: Column) -> Column:
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda s, v: s + v)
    shares = lambda s: _once(F.transform(s, lambda x: F.exp(x - F.array_max(s))), lambda e: F.transform(e, lambda x: x / total(e)))
    return _once(scores, shares)


def _smoothed(counts: Column, above: Column) -> Column:
    """Shares of the counts with STRENGTH rows more that are spread as above."""
    total = F.aggregate(counts, F.lit(STRENGTH), lambda s, v: s + v)
    return F.zip_with(counts, above, lambda x, p: (x + STRENGTH * p) / total)


def identify(rows: DataFrame, model: TextModel, key: str, text: str = "text", declared: str | None = None, address: str | None = None, markup: bool = False, least: float = LEAST) -> DataFrame:
    """key, language, confidence, letters, rejected for each row of rows.

    declared, address: columns with the declared language and the address, if any; markup: text is HTML, whose own lang
    attribute counts as declared where `declared` is None.
    """
    languages, n = model.languages, len(model.languages)
    told = F.col(declared) if declared else declared_in(F.col(text)) if markup else F.lit(None).cast("string")
    host, domain, suffix = _levels(F.col(address)) if address else (F.lit(""), F.lit(""), F.lit(""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text"):
            found = [model.evidence(plain_text(t) if markup else t) if t else (np.zeros(n), 0) for t in b.column(5).to_pylist()]
            logs = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * n), pa.array(np.concatenate([x for x, _ in found])))
            yield pa.RecordBatch.from_arrays([*b.columns[:5], logs, pa.array([k for _, k in found], pa.int64())], ["key", "told", "host", "domain", "suffix", "logs", "letters"])

    told = F.lower(F.regexp_extract(F.coalesce(told, F.lit("")), r"^([A-Za-z]+)", 1))
    kind = dict(rows.dtypes)[key]
    asked = rows.select(F.col(key).alias("key"), told.alias("told"), host.alias("host"), domain.alias("domain"), suffix.alias("suffix"), F.col(text).alias("text"))
    seen = asked.mapInArrow(tidy(run), f"key {kind}, told string, host string, domain string, suffix string, logs array<double>, letters long")
    if not n:
        unknown = F.lit(None).cast("string"), F.lit(0.0)
        return seen.select(F.col("key").alias(key), unknown[0].alias("language"), unknown[1].alias("confidence"), "letters", (F.col("letters") == 0).alias("rejected"))
    of_suffix = F.element_at(F.create_map(*(F.lit(x) for kv in SUFFIXES.items() for x in kv)), F.col("suffix"))
    own = F.zip_with(F.zip_with("logs", _logs(languages, F.col("told"), DECLARED), lambda a, b: a + b), _logs(languages, of_suffix, SUFFIX), lambda a, b: a + b)
    share = F.when(F.col("letters") > 0, _softmax(F.col("own"))).otherwise(F.array(*[F.lit(0.0)] * n))
    seen = materialise(seen.withColumn("own", own).withColumn("share", share), "language-evidence")
    fused = seen.join(_level_sums(seen, n), ["suffix", "domain", "host"])
    prior = F.array(*[F.lit(1.0 / n)] * n)
    for level in ("of_all", "of_suffix", "of_domain", "of_host"):
        prior = _smoothed(F.zip_with(level, "share", lambda a, b: F.greatest(a - b, F.lit(0.0))), prior)
    fused = fused.withColumn("posterior", _softmax(F.zip_with("own", prior, lambda a, p: a + F.ln(p))))
    best = F.array_max("posterior")
    language = F.element_at(F.array(*(F.lit(x) for x in languages)), F.array_position("posterior", best).cast("int"))
    out = fused.select(F.col("key").alias(key), language.alias("language"), best.alias("confidence"), "letters")
    return out.withColumn("rejected", (F.col("letters") == 0) | (F.col("confidence") < least))


def _level_sums(seen: DataFrame, n: int) -> DataFrame:
    """suffix, domain, host, and for each level up to all rows the sum of the shares below it, as arrays of_host to of_all."""
    sums = [F.sum(F.col("share")[i]).alias(f"n{i}") for i in range(n)]
    up = [F.sum(f"n{i}").alias(f"n{i}") for i in range(n)]
    packed = lambda df, name, *by: df.select(*by, F.array(*(f"n{i}" for i in range(n))).alias(name))
    hosts = materialise(seen.groupBy("suffix", "domain", "host").agg(*sums), "language-hosts")
    out = packed(hosts, "of_host", "suffix", "domain", "host")
    out = out.join(packed(hosts.groupBy("suffix", "domain").agg(*up), "of_domain", "suffix", "domain"), ["suffix", "domain"])
    out = out.join(packed(hosts.groupBy("suffix").agg(*up), "of_suffix", "suffix"), "suffix")
    return out.crossJoin(F.broadcast(packed(hosts.agg(*up), "of_all")))
