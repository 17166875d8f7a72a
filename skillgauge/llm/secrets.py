"""Secret scans with column expressions alone: fixed patterns, and Markov models of characters.

Strings that hang together (letters, digits, a few signs) are scored by two
first-order Markov models of characters, one of random strings and one of
ordinary identifiers. A string whose mean log-likelihood ratio per step is above
a bound is a span of kind `random`. The models are trained from labelled samples:
values behind credential names, access keys and long hexadecimal runs of the
documents, with hashes of running numbers, against long alphabetic words of the
documents, with a list of ordinary identifiers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns that count as they stand, in the order of kinds.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
MIN_VALUE = 8

# Strings the models look at: of one length at least and never a part of a longer one.
CANDIDATE = r"[A-Za-z0-9+/_-]{16,}"
ORDINARY = r"[A-Za-z_-]{12,}"
KINDS = ("assign", "access", "hex", "random")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
SIZE = len(ALPHABET) + 1  # place 0 is any other character
# Mean log ratio per step, in nats, above which a string counts as random.
MIN_RATIO = 0.5

# Ordinary identifiers as labelled samples, beside the words of the documents.
IDENTIFIERS = (
    "get_user_name set_default_value max_iterations createConnection parseRequestBody is_valid_address "
    "computeTotalAmount load_configuration_file open_output_stream ApplicationContext AbstractFactoryBean "
    "number_of_partitions learning_rate_schedule normalize_whitespace toString valueOf readLine writeBytes "
    "user-agent content-type last-modified transfer-encoding DEFAULT_BUFFER_SIZE MAX_RETRY_COUNT LOG_LEVEL "
    "path/to/some/file src/main/resources tests/unit/helpers usr/local/share/doc var/log/messages "
    "http_response_code database_connection_pool row_count_estimate image_width_pixels thread_local_storage"
).split()
# Hashes of this many running numbers are labelled random in every training, so
# that a corpus without secrets has a model too.
RANDOM_SAMPLES = 2000

# Working columns, named so that no column of a caller clashes.
BASE, ALL = "_secret_spans_base", "_secret_spans_all"

# Steps by which single characters smooth a row of a model.
PRIOR = 5.0

SPANS = "array<struct<start:bigint,rank:int,end:bigint,value:string>>"
NO_SPANS = f"CAST(array() AS {SPANS})"


def spans(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """Spans of all matches of `pattern`: structs of start, rank of the kind, end and the match itself.

    Starts are running sums over the parts between the matches and the matches.
    Texts without a match, nearly all, are not split.
    """
    rank = F.lit(KINDS.index(kind))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["part"]).cast("bigint")
        end = start + F.length(pair["match"])
        span = F.struct(start.alias("start"), rank.alias("rank"), end.alias("end"), pair["match"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    # The part after the last match has no match beside it and is left out.
    both = F.arrays_zip(F.split(text, pattern).alias("part"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))
    both = F.filter(both, lambda pair: pair["match"].isNotNull())
    every = F.aggregate(both, F.struct(F.lit(0).cast("bigint").alias("at"), F.expr(NO_SPANS).alias("out")), step, lambda acc: acc["out"])
    if keep is not None:
        every = F.filter(every, lambda s: keep(s["value"]))
    return F.when(F.rlike(text, F.lit(pattern)), every).otherwise(F.expr(NO_SPANS))


def base_spans(text: Column) -> Column:
    long_value = lambda match: F.length(F.regexp_extract(match, ASSIGN, 1)) >= MIN_VALUE
    return F.concat(spans(text, ASSIGN, "assign", long_value), spans(text, ACCESS, "access"), spans(text, HEX, "hex"))


def code(s: Column, i: Column) -> Column:
    """Place in the flattened table of the step from character i - 1 to character i."""
    before, at = F.substring(s, i - 1, F.lit(1)), F.substring(s, i, F.lit(1))
    return F.position(before, F.lit(ALPHABET)) * SIZE + F.position(at, F.lit(ALPHABET))


def pair_counts(strings: DataFrame) -> DataFrame:
    """Of strings `s` with a `label`: label, code of each pair of neighbouring characters, and how often it occurs."""
    steps = F.transform(F.sequence(F.lit(2), F.length("s")), lambda i: code(F.col("s"), i))
    return strings.where(F.length("s") >= 2).select("label", F.explode(steps).alias("code")).groupBy("label", "code").agg(F.count("*").alias("n"))


def labelled(docs: DataFrame) -> DataFrame:
    """Labelled strings (label 1 random, 0 ordinary): all that the documents hold, and the fixed ones."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    values = lambda pattern, group: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    # Values in plain letters are words, as in "token: undefined".
    value = F.filter(values(ASSIGN, 1), lambda v: (F.length(v) >= MIN_VALUE) & F.rlike(v, F.lit("[0-9]")))
    random = F.transform(F.concat(value, values(ACCESS, 0), values(HEX, 0)), lambda s: F.struct(F.lit(1).alias("label"), s.alias("s")))
    ordinary = F.transform(values(ORDINARY, 0), lambda s: F.struct(F.lit(0).alias("label"), s.alias("s")))
    corpus = docs.select(F.explode(F.concat(random, ordinary)).alias("x")).select("x.*")
    digest = F.sha2(F.col("id").cast("string"), 256)
    mixed = F.base64(F.unhex(digest))
    made = spark.range(RANDOM_SAMPLES).select(
        F.lit(1).alias("label"), F.explode(F.array(F.substring(digest, 1, 40), F.substring(mixed, 1, 40), F.upper(F.substring(mixed, 1, 20)))).alias("s")
    )
    listed = spark.range(1).select(F.lit(0).alias("label"), F.explode(F.array(*map(F.lit, IDENTIFIERS))).alias("s"))
    return corpus.unionByName(made).unionByName(listed)


def train(docs: DataFrame) -> list[float]:
    """Log-likelihood ratio of each step, as a flat table of SIZE * SIZE values; the driver gets no more rows than twice that.

    Steps of both models are smoothed by their frequencies of single characters.
    """
    counts = {0: [0] * (SIZE * SIZE), 1: [0] * (SIZE * SIZE)}
    for row in pair_counts(labelled(docs)).collect():
        counts[row["label"]][row["code"]] += row["n"]
    ordinary, random = (log_model(counts[label]) for label in (0, 1))
    return [r - o for o, r in zip(ordinary, random, strict=True)]


def log_model(counts: list[int]) -> list[float]:
    """Log probability of each step: its count, and PRIOR further steps that follow the frequency of the character reached."""
    total = sum(counts)
    single = [(sum(counts[at::SIZE]) + 0.5) / (total + 0.5 * SIZE) for at in range(SIZE)]
    out = []
    for before in range(SIZE):
        row = counts[before * SIZE : (before + 1) * SIZE]
        whole = sum(row) + PRIOR
        out += [math.log((n + PRIOR * p) / whole) for n, p in zip(row, single, strict=True)]
    return out


def mean_ratio(s: Column, table: Column) -> Column:
    """Mean log ratio per step of a string of two characters or more."""
    total = F.aggregate(F.sequence(F.lit(2), F.length(s)), F.lit(0.0), lambda acc, i: acc + F.get(table, code(s, i)))
    return total / (F.length(s) - 1)


def with_spans(docs: DataFrame, ratios: list[float], min_ratio: float = MIN_RATIO) -> DataFrame:
    """`docs` with two columns: the plain spans, and all spans in order of start, rank of the kind and end."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    held = docs.withColumn(BASE, F.array_sort(base_spans(text)))
    # A string within a plain span adds nothing to it; one that reaches out of it does.
    random = spans(text, CANDIDATE, "random", lambda s: mean_ratio(s, table) > min_ratio)
    free = F.filter(random, lambda r: ~F.exists(BASE, lambda b: (b["start"] <= r["start"]) & (r["end"] <= b["end"])))
    return held.withColumn(ALL, F.array_sort(F.concat(BASE, free)))


def listing(found: Column) -> Column:
    name = lambda s: F.get(F.array(*map(F.lit, KINDS)), s["rank"])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets(docs: DataFrame, min_ratio: float = MIN_RATIO) -> DataFrame:
    """One row per document: numbers of plain spans by kind, their digest, and all spans as text.

    A null text counts as empty and has no spans; its digest is that of the empty
    string. Repeated rows are scanned each for itself. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = with_spans(docs, train(docs), min_ratio)
    number = lambda kind: F.size(F.filter(BASE, lambda s: s["rank"] == KINDS.index(kind))).cast("bigint")
    return held.select(
        "doc_id",
        *[number(kind).alias(f"n_{kind}") for kind in KINDS[:3]],
        F.sha2(listing(F.col(BASE)), 256).alias("base_sha256"),
        listing(F.col(ALL)).alias("spans"),
        (F.size(ALL) - F.size(BASE)).cast("bigint").alias("n_random"),
    )


def redacted(docs: DataFrame, mark: str = "[SECRET]", min_ratio: float = MIN_RATIO) -> DataFrame:
    """`docs` with every span of its texts replaced by `mark`; spans that overlap are replaced together."""
    names = docs.columns
    held = with_spans(docs, train(docs), min_ratio)

    def step(acc: Column, s: Column) -> Column:
        before = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        fresh = s["start"] >= acc["at"]
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], before, F.lit(mark))).otherwise(acc["out"]).alias("out")
        )

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    rest = lambda acc: F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text")))
    clean = F.when(F.size(ALL) > 0, F.aggregate(ALL, start, step, rest)).otherwise(F.col("text"))
    return held.withColumn("text", clean).select(*names)
