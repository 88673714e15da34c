"""Operator 13, secret scans by character Markov models; DataFrame functions only.

Two first-order Markov models of characters stand against each other: one of random strings,
one of ordinary identifiers.  Both are trained from labelled samples (text, label): every
distinct sample counts once, so a secret copied a thousand times teaches no more than once
and a common word no more than a rare one.  A string's score is the sum over its neighbouring
characters of ln P(next | one, random) - ln P(next | one, ordinary), kept per pair as a whole
number of thousandths, so sums do not depend on their order.

``labelled_samples`` takes its samples from every document: ordinary (0) are all tokens of 8
characters or more without a base match; random (1) are the values of base matches, and for
every document the digest of its id, in base 64 or in small or capital base 16, so that a
corpus without secrets still teaches what random strings look like.  The samples are made
distinct before their pairs are counted, and pairs are counted map-side, at most 2 * 67 * 67
rows a task.

A document's spans are the base matches (three fixed rules) and, as kind ``random``, its
tokens of 16 characters or more that hold a digit and a letter and whose score reaches
``THRESHOLD``.  A token may lie in a base match; both spans stay.

Places count code points.  A rule's matches and the pieces between them (``split`` by the same
expression) give the places as running sums of lengths, summed in blocks of ``BLOCK`` so that a
text with very many matches does not take quadratic time.

Bounds: the driver collects the pair counts (at most 2 * 67 * 67 rows) and sends the scores as
one literal array of 16,384 numbers; documents are scanned where they lie, without a shuffle.

Cases: null and empty texts have no spans and the digest of the empty text; matches of
different kinds may overlap and come by start, then kind; repeated rows are repeated; without
samples all pairs score 0 and no token is added; null and empty samples are passed over; an
empty table gives no rows; other columns are never read, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"   # 16 characters or more of AKIA[A-Z0-9]+
HEX = r"[0-9a-f]{32,}"          # 32 characters or more of [0-9a-f]+
ASSIGN_LENGTH = 8
KINDS = ("assign", "access", "hex", "random")

#: what the models read: characters of identifiers, keys and base 64
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
SAMPLE = r"[A-Za-z0-9+/_=-]{8,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{16,}={0,2}"
#: a random string is this many thousandths of a natural logarithm likelier than an ordinary one
THRESHOLD = 10_000
BLOCK = 256


def _named(text: Column) -> Column:
    """Whether a text can hold an ``assign`` match: any of its words, in any case."""
    low = F.lower(text)
    return low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("apikey") | low.contains("api_key")


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _strings() -> Column:
    return F.array().cast("array<string>")


def _value(match: Column) -> Column:
    return F.regexp_extract(match, ASSIGN, 1)


def labelled_samples(docs: DataFrame) -> DataFrame:
    """Distinct (text, label) from all of ``docs``: 1 random, 0 ordinary."""
    text = F.col("text")
    values = F.filter(F.transform(_all(text, ASSIGN), _value), lambda v: F.length(v) >= ASSIGN_LENGTH)
    rest = F.when(_named(text), F.regexp_replace(text, ASSIGN, " ")).otherwise(text)
    digest = F.sha2(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"), 256)
    made = F.when(digest < "3", digest).when(digest < "6", F.upper(digest)).otherwise(F.base64(F.unhex(digest)))
    random = F.concat(F.array(made), F.when(_named(text), values).otherwise(_strings()))
    tokens = docs.select(F.explode(_all(rest, SAMPLE)).alias("text")).distinct()
    found = F.when(F.length("text") >= 16, F.regexp_extract("text", f"{HEX}|{ACCESS}", 0)).otherwise(F.lit(""))
    tokens = tokens.select(F.when(found != "", found).otherwise(F.col("text")).alias("text"), F.when(found != "", 1).otherwise(0).alias("label"))
    return tokens.unionByName(docs.select(F.explode(random).alias("text"), F.lit(1).alias("label"))).distinct()


def train(samples: DataFrame) -> list[int]:
    """Scores in thousandths, at 128 * code of one character + code of the next; 0 where a character
    is not in ``SYMBOLS``.  Each sample row counts once; shares are smoothed by one for every symbol."""
    chars = F.filter(F.split("text", ""), lambda c: c != "")
    pairs = F.zip_with(F.slice(chars, 1, F.greatest(F.size(chars) - 1, F.lit(0))), F.slice(chars, 2, F.size(chars)), lambda a, b: F.concat(a, b))
    counted = samples.where("text <> '' and label in (0, 1)").select("label", F.explode(pairs).alias("pair")) \
        .groupBy("label", "pair").agg(F.count("*").alias("n"))
    known = F.col("pair").rlike(r"^[A-Za-z0-9+/_=-]{2}$")
    count = {(r["label"], r["pair"]): r["n"] for r in counted.where(known).collect()}  # at most 2 * 67 * 67 rows
    after = {(label, a): sum(count.get((label, a + b), 0) for b in SYMBOLS) for label in (0, 1) for a in SYMBOLS}
    scores = [0] * (128 * 128)
    for a in SYMBOLS:
        for b in SYMBOLS:
            random, plain = (math.log((count.get((label, a + b), 0) + 1) / (after[label, a] + len(SYMBOLS))) for label in (1, 0))
            scores[128 * ord(a) + ord(b)] = math.floor(1000 * (random - plain) + 0.5)
    return scores


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda total, x: total + x)


def score(token: Column, scores: list[int]) -> Column:
    """Log-likelihood ratio of a token, in thousandths."""
    table = F.split(F.lit(",".join(map(str, scores))), ",").cast("array<int>")  # folded to one literal
    codes = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.ascii(c))
    pairs = F.zip_with(F.slice(codes, 1, F.greatest(F.size(codes) - 1, F.lit(0))), F.slice(codes, 2, F.size(codes)),
                       lambda a, b: F.element_at(table, 128 * a + b + 1))
    return _total(pairs)


def _running(steps: Column) -> Column:
    """Running sums: blocks of BLOCK steps, then places inside a block."""
    n_blocks = F.ceil(F.size(steps) / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda k: F.slice(steps, k * BLOCK + 1, F.lit(BLOCK)))
    sums = F.transform(blocks, _total)
    starts = F.transform(sums, lambda _, k: _total(F.slice(sums, F.lit(1), k)))
    inside = F.zip_with(blocks, starts, lambda block, at: F.transform(block, lambda _, k: at + _total(F.slice(block, F.lit(1), k + 1))))
    return F.flatten(inside)


def _spans(text: Column, matches: Column, pattern: str, kind: int) -> Column:
    """(start, kind, end, value) of each match, in code points."""
    between = F.split(text, pattern)
    steps = F.zip_with(F.slice(between, 1, F.size(matches)), F.concat(F.array(F.lit("")), matches), lambda gap, match: F.length(gap) + F.length(match))
    steps = F.slice(steps, 1, F.size(matches))
    ends = F.zip_with(_running(steps), matches, lambda at, match: F.struct(
        at.cast("long").alias("start"), F.lit(kind).alias("kind"), (at + F.length(match)).cast("long").alias("end"), match.alias("value")))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,value:string>>")
    return F.when(F.size(matches) > 0, ends).otherwise(none)


def secret_spans(docs: DataFrame, scores: list[int], threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, base and spans: arrays of (start, kind, end, value) by start, then kind; kind counts ``KINDS``."""
    text = F.col("text")

    def within_tokens(pattern):  # such a match lies in one token, so most texts need no second look
        return F.when(F.exists("m3", lambda t: t.rlike(pattern)), _all(text, pattern)).otherwise(_strings())

    found = docs.select("doc_id", F.coalesce(text, F.lit("")).alias("text"))
    found = found.select("doc_id", "text", F.when(_named(text), _all(text, ASSIGN)).otherwise(_strings()).alias("m0"), _all(text, CANDIDATE).alias("m3"))
    found = found.select("doc_id", "text", "m0", "m3", within_tokens(ACCESS).alias("m1"), within_tokens(HEX).alias("m2"),
                         F.exists("m3", _mixed).alias("look"))
    found = found.withColumn("m3", F.when(F.col("look"), F.col("m3")).otherwise(_strings()))
    found = found.select("doc_id", *(_spans(text, F.col(f"m{k}"), p, k).alias(f"s{k}") for k, p in enumerate((ASSIGN, ACCESS, HEX, CANDIDATE))))
    assign = F.filter("s0", lambda s: F.length(_value(s["value"])) >= ASSIGN_LENGTH)
    added = F.filter("s3", lambda s: _mixed(s["value"]) & (score(s["value"], scores) >= threshold))
    found = found.select("doc_id", F.array_sort(F.concat(assign, "s1", "s2")).alias("base"), added.alias("added"))
    return found.select("doc_id", "base", F.array_sort(F.concat("base", "added")).alias("spans"))


def _mixed(token: Column) -> Column:
    return token.rlike("[0-9]") & token.rlike("[A-Za-z]")


def _listed(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans; the models learn from all of ``docs``."""
    found = secret_spans(docs, train(labelled_samples(docs)))

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return found.select("doc_id", count(0), count(1), count(2), F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
