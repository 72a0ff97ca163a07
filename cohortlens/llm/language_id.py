"""Language identification by Bayesian fusion of evidence."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import stored

#: Hash classes of letter trigrams, and how many of them a row of partial counts holds.
CLASSES, SLICE = 1 << 16, 1 << 11
#: A text counts as this many trigrams at most: neighbouring ones say the same.
EVIDENCE = 60.0
#: Weight of a parent level against a host's own pages; smoothing of the tables.
STRENGTH, ALPHA = 20.0, 1.0
#: Name and prior of "no known language".
UNKNOWN, UNKNOWN_PRIOR = "und", 1e-4
MIN_PROBABILITY = 0.5

# Letters by byte: A-Z in lower case, bytes above ASCII as they are, all else a space.
_LETTER = np.array([b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)], np.uint8)


def _trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, class) of every trigram of letters and single spaces."""
    sizes = np.array([len(t) + 2 for t in texts])
    raw = _LETTER[np.frombuffer(b" " + b"  ".join(texts) + b" ", np.uint8)]
    # Capital Latin-1 letters (bytes C3 80..9E, but not the sign 97) in lower case.
    upper = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)) + 1
    raw[upper] += 32
    owner = np.repeat(np.arange(len(texts)), sizes)
    keep = np.ones(len(raw), bool)
    keep[1:] = (raw[1:] != 32) | (raw[:-1] != 32) | (owner[1:] != owner[:-1])
    raw, owner = raw[keep].astype(np.uint32), owner[keep]
    if len(raw) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.uint16)
    code = (raw[:-2] << np.uint32(16) | raw[1:-1] << np.uint32(8) | raw[2:]) * np.uint32(0x9E3779B1) >> np.uint32(16)
    inside = owner[:-2] == owner[2:]
    return owner[:-2][inside], code[inside].astype(np.uint16)


def _pieces(column: pa.Array, limit: int = 1 << 20):
    """(row number, bytes) lists of bounded size; long texts go in parts that
    share two bytes, so that whole texts count."""
    rows, texts, size = [], [], 0
    for i, x in enumerate(column.cast(pa.large_binary())):
        t = x.as_py() or b""
        for at in range(0, max(1, len(t)), limit):
            part = t[at:at + limit]
            rows.append(i)
            texts.append(part)
            size += len(part)
            if size >= limit:
                yield rows, texts
                rows, texts, size = [], [], 0
    if rows:
        yield rows, texts


_SLICE_DDL = "language string, slice int, counts binary"


def _slices(found: dict[tuple[str, int], np.ndarray]):
    """Batches of (language, slice, packed counts)."""
    keys = list(found)
    for at in range(0, len(keys), 256):
        own = keys[at:at + 256]
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in own], pa.string()), pa.array([i for _, i in own], pa.int32()),
                                          pa.array([blocks.pack(found[k]) for k in own], pa.binary())], names=["language", "slice", "counts"])


def fit_likelihoods(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log likelihood of each trigram class under each language)
    from all (id, text, language) rows, so that every declared language whose
    texts have letters is known. The last row is the unknown language, under
    which every class is as likely.

    A task counts its own rows; its counts of a language leave in slices of
    classes and are summed by (language, slice). The driver gets the totals:
    half a megabyte a language."""

    @blocks.frugal
    def count(batches):
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(1).to_pylist()
            for rows, texts in _pieces(batch.column(0)):
                owner, code = _trigrams(texts)
                for name in {names[r] for r in rows}:
                    own = np.array([names[r] == name for r in rows])
                    found[name] = found.get(name, 0) + np.bincount(code[own[owner]], minlength=CLASSES)
        yield from _slices({(name, i): part for name, c in found.items() for i, part in enumerate(c.reshape(-1, SLICE)) if part.any()})

    @blocks.frugal
    def add(batches):
        found: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for name, i, c in zip(*(batch.column(k).to_pylist() for k in range(3))):
                found[name, i] = found.get((name, i), 0) + blocks.unpack(c)[0]
        yield from _slices(found)

    counts: dict[str, np.ndarray] = {}
    parts = labelled.where("text is not null and language is not null").select("text", "language").mapInArrow(count, _SLICE_DDL)
    for r in parts.repartition("language", "slice").mapInArrow(add, _SLICE_DDL).collect():
        counts.setdefault(r.language, np.zeros(CLASSES, np.int64))[r.slice * SLICE:(r.slice + 1) * SLICE] += blocks.unpack(bytes(r.counts))[0]
    names = sorted(counts)
    # Half of a likelihood is spread evenly: unseen trigrams cost little.
    rows = [np.log(0.5 * counts[n] / counts[n].sum() + 0.5 / CLASSES) for n in names]
    return names, np.array([*rows, np.full(CLASSES, -np.log(CLASSES))], np.float64)


def text_evidence(rows: DataFrame, table: np.ndarray, text_col: str = "text") -> DataFrame:
    """``rows`` without the text, with evidence (array<double>): the tempered
    log likelihood of the whole text per language (last: unknown), and
    trigrams (long). A text without letters has evidence 0 for each."""
    names = [c for c in rows.columns if c != text_col]

    @blocks.frugal
    def run(batches):
        flat = np.ascontiguousarray(table.T)
        for batch in batches:
            total = np.zeros((batch.num_rows, len(table)))
            n = np.zeros(batch.num_rows, np.int64)
            for own, texts in _pieces(batch.column(text_col)):
                owner, code = _trigrams(texts)
                if not len(owner):
                    continue
                first = np.flatnonzero(np.diff(owner, prepend=-1))
                at = np.array(own)[owner[first]]
                np.add.at(total, at, np.add.reduceat(flat[code], first, axis=0))
                np.add.at(n, at, np.diff(np.append(first, len(owner))))
            total *= (np.minimum(n, EVIDENCE) / np.maximum(n, 1))[:, None]
            ends = pa.array(np.arange(0, total.size + 1, len(table)), pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.ListArray.from_arrays(ends, pa.array(total.ravel())), pa.array(n)],
                                             names=[*names, "evidence", "trigrams"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != text_col)
    return rows.mapInArrow(run, f"{fields}, evidence array<double>, trigrams long")


def _best(scores: Column, names: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), F.array_position(scores, F.array_max(scores)).cast("int"))


def _shares(rows: DataFrame, key: str, names: list[str], out: str) -> DataFrame:
    """(key, out): rows per text language for each ``key``."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.array(*[F.count_if(F.col("_best") == n).cast("double") for n in names]).cast("array<double>").alias(out))


def identify(rows: DataFrame, names: list[str], table: np.ndarray, accept: list[str] | None = None,
             min_probability: float = MIN_PROBABILITY) -> DataFrame:
    """``rows`` (text, declared, suffix, host and any others) with the text
    replaced by language, probability, accepted.

    Log evidence is summed: the whole text's likelihood; the likelihoods of
    the declared language and of the address suffix given a language, and
    the host's prior. The last three are counted over all rows by the
    language that their texts show: a host's prior is smoothed towards its
    parent domain's, that towards the whole corpus's. Accepted: the most
    probable language is a known one (of ``accept``, if given) and has
    ``min_probability`` at least.

    Null or empty text: no text evidence; the others decide, or, without
    letters and any other evidence, the row is rejected with language und.
    Null declared, suffix or host: no evidence of that kind. Repeated rows
    stay; an empty table gives an empty result. Counts meet in partial sums
    and come back by joins, so a hot host never fills a task."""
    every = [*names, UNKNOWN]
    scored = stored(text_evidence(rows, table).withColumn("_best", F.when(F.col("trigrams") > 0, _best(F.col("evidence"), every)))
                    .withColumn("_domain", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)), "evidence")
    whole = scored.agg(F.count("*"), *[F.count_if(F.col("_best") == n) for n in names]).first()[1:]
    n_all = sum(whole)
    prior = [(c + ALPHA) / (n_all + ALPHA * len(names)) for c in whole]
    log_given = lambda counts: [F.log((F.coalesce(F.element_at(counts, j + 1), F.lit(0.0)) + ALPHA) / (whole[j] + 2 * ALPHA)) for j in range(len(names))]
    out = scored
    for key, name in (("declared", "_declared"), ("suffix", "_suffix"), ("_domain", "_by_domain"), ("host", "_by_host")):
        counts = _shares(scored.where("_best is not null"), key, names, name).withColumnRenamed(key, f"{name}_key")
        out = out.join(counts, F.col(key) == F.col(f"{name}_key"), "left").drop(f"{name}_key")

    def shrink(counts: str, parent: list[Column]) -> list[Column]:
        c = [F.coalesce(F.element_at(counts, j + 1), F.lit(0.0)) for j in range(len(names))]
        n = F.coalesce(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x), F.lit(0.0))
        return [(x + STRENGTH * p) / (n + STRENGTH) for x, p in zip(c, parent, strict=True)]

    host = shrink("_by_host", shrink("_by_domain", [F.lit(p) for p in prior]))
    declared = [F.when(F.col("_declared").isNotNull(), x).otherwise(0.0) for x in log_given(F.col("_declared"))]
    suffix = [F.when(F.col("_suffix").isNotNull(), x).otherwise(0.0) for x in log_given(F.col("_suffix"))]
    scores = [F.element_at("evidence", j + 1) + declared[j] + suffix[j] + F.log(host[j]) for j in range(len(names))]
    # The unknown language explains each declaration and suffix as well as the average language.
    free = [F.when(F.col(c).isNotNull(), F.log((F.aggregate(F.col(c), F.lit(0.0), lambda a, x: a + x) + ALPHA) / (n_all + 2 * ALPHA))).otherwise(0.0)
            for c in ("_declared", "_suffix")]
    scores.append(F.element_at("evidence", len(names) + 1) + free[0] + free[1] + F.lit(float(np.log(UNKNOWN_PRIOR))))
    out = out.withColumn("_scores", F.array(*scores))
    out = out.withColumn("_total", F.aggregate(F.transform("_scores", lambda x: F.exp(x - F.array_max("_scores"))), F.lit(0.0), lambda a, x: a + x))
    nothing = (F.col("trigrams") == 0) & F.col("_declared").isNull() & F.col("_suffix").isNull() & F.col("_by_host").isNull()
    out = out.withColumn("language", F.when(nothing, UNKNOWN).otherwise(_best(F.col("_scores"), every)))
    out = out.withColumn("probability", F.when(nothing, 0.0).otherwise(1 / F.col("_total")))
    fine = F.col("language").isin(accept if accept is not None else names) & (F.col("probability") >= min_probability)
    keep = [c for c in rows.columns if c not in ("text", "language", "probability", "accepted")]
    return out.select(*keep, "language", "probability", fine.alias("accepted"))


def primary_tag(tag: Column) -> Column:
    """en of en-GB or EN_us; null if there is none."""
    t = F.lower(F.regexp_extract(tag, r"^\s*([A-Za-z]{2,3})(?:[-_].*)?\s*$", 1))
    return F.when(t != "", t)


def markup_language(html: Column) -> Column:
    return primary_tag(F.regexp_extract(html, r"(?i)<html[^>]*?\slang\s*=\s*[\"']?([A-Za-z_-]+)", 1))


def address_suffix(host: Column) -> Column:
    t = F.regexp_extract(host, r"\.([a-z]{2,})$", 1)
    return F.when(t != "", t)


def visible_text(html: Column) -> Column:
    """A page without scripts, styles, comments and tags."""
    return F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>", " ")


def document_evidence(docs: DataFrame) -> DataFrame:
    """Evidence of documents (doc_id, text, lang, source): the label is what is
    declared, the source stands for the host; there is no address suffix."""
    return docs.select("doc_id", F.lit(None).cast("long").alias("page_id"), "text", primary_tag(F.col("lang")).alias("declared"),
                       F.lit(None).cast("string").alias("suffix"), F.col("source").cast("string").alias("host"))


def page_evidence(pages: DataFrame) -> DataFrame:
    """Evidence of crawled pages (page_id, url, html)."""
    from .line_dedup import host_of
    host = host_of(F.col("url"))
    return pages.select(F.lit(None).cast("long").alias("doc_id"), "page_id", visible_text(F.col("html")).alias("text"),
                        markup_language(F.col("html")).alias("declared"), address_suffix(host).alias("suffix"), host.alias("host"))


def corpus_languages(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """Languages of all documents and pages: doc_id or page_id, declared,
    suffix, host, language, probability, accepted. The likelihoods are fitted
    on all labelled documents."""
    names, table = fit_likelihoods(docs.select(F.col("doc_id").alias("id"), "text", primary_tag(F.col("lang")).alias("language")))
    return identify(document_evidence(docs).unionByName(page_evidence(pages)), names, table)
